"""Media columns as MPEG transport streams.

A payload is cut into access units, each a PES packet with a presentation timestamp; these are cut into 188-byte
transport packets. Every `rap_every` units comes a random-access point: the program association and program map tables
anew, then a packet with the clock reference and the random-access flag. Timestamps and random-access points are stored
beside the stream as its index; a stream can be read from any of these points on.

The reader trusts nothing but the bytes: it puts sections together, checks their CRC, parses the association table
(network entries left out) and the map table (descriptors skipped) for the stream of the first program, checks the
continuity counter of each packet identifier (a repeated packet is legal and is skipped, a lost one is counted),
reassembles PES packets and lists timestamps with the random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

PACKET, PMT_PID, ES_PID, PROGRAM = 188, 0x1000, 0x100, 1
UNIT, TICKS, RAP_EVERY = 2048, 3600, 8
_REVERSED = [int(f"{i:08b}"[::-1], 2) for i in range(256)]
_FLIP = bytes(_REVERSED)


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: zlib's with bits of bytes and result reversed, without the last inversion."""
    value = zlib.crc32(data.translate(_FLIP)) ^ 0xFFFFFFFF
    return int(f"{value:032b}"[::-1], 2)


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return head + section + b"\xff" * (PACKET - len(head) - len(section))


_ASSOCIATION = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_MAP = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _pts(t: int) -> bytes:
    return bytes([0x21 | (t >> 29 & 0x0E), t >> 22 & 255, (t >> 14 & 0xFE) | 1, t >> 7 & 255, (t << 1 & 0xFE) | 1])


def _clock(t: int) -> bytes:
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes, unit: int = UNIT, rap_every: int = RAP_EVERY) -> bytes:
    """The transport stream of a payload."""
    out, counter = [], 0
    for number, at in enumerate(range(0, len(payload), unit)):
        chunk, t = payload[at : at + unit], TICKS * number % 2**33
        pes = b"\x00\x00\x01\xbd" + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(t) + chunk
        adapt = b"\x07\x10" + _clock(t)
        if number % rap_every == 0:
            turn = number // rap_every
            out += [_table_packet(0, _ASSOCIATION, turn), _table_packet(PMT_PID, _MAP, turn)]
            adapt = b"\x07\x50" + _clock(t)
        start, done = 0x40, 0
        while done < len(pes):
            room = PACKET - 4 - len(adapt)
            part = pes[done : done + room]
            short = room - len(part)
            if short:
                # stuffing lengthens the adaptation field
                if adapt:
                    field_ = bytes([adapt[0] + short]) + adapt[1:] + b"\xff" * short
                else:
                    field_ = bytes([short - 1]) + (b"\x00" + b"\xff" * (short - 2) if short > 1 else b"")
            else:
                field_ = adapt
            out.append(bytes([0x47, start | ES_PID >> 8, ES_PID & 255, (0x30 if field_ else 0x10) | counter]) + field_ + part)
            counter, start, done, adapt = counter + 1 & 15, 0, done + len(part), b""
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    packets: int = 0
    errors: int = 0
    timestamps: list = field(default_factory=list)
    access_points: list = field(default_factory=list)  # (timestamp, number of the packet to read from)


@dataclass
class _Packet:
    number: int
    pid: int
    start: bool
    random_access: bool
    payload: bytes | None


def _packets(data: bytes, out: Stream):
    """Packets without legal repeats; counts those that are lost."""
    last: dict[int, tuple[int, bytes]] = {}
    for number in range(len(data) // PACKET):
        packet = data[number * PACKET : number * PACKET + PACKET]
        if packet[0] != 0x47 or packet[1] & 0x80:
            raise ValueError("out of step, or marked as broken")
        pid, control = (packet[1] & 0x1F) << 8 | packet[2], packet[3]
        at, flags = 4, 0
        if control & 0x20:
            flags, at = packet[5] if packet[4] else 0, 5 + packet[4]
        counter, carries = control & 15, bool(control & 0x10)
        if pid != 0x1FFF and pid in last:
            before, same = last[pid]
            if carries and counter == before and packet == same:
                continue
            if not flags & 0x80 and counter != (before + 1 & 15 if carries else before):
                out.errors += 1
        if pid != 0x1FFF:
            last[pid] = counter, packet
        yield _Packet(number, pid, bool(packet[1] & 0x40), bool(flags & 0x40), packet[at:] if carries else None)


class _Sections:
    """Puts the sections of one packet identifier together."""

    def __init__(self):
        self.held: bytes | None = None

    def add(self, p: _Packet):
        data = p.payload
        if data is None:
            return
        if p.start:
            head, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if self.held is not None:
                self.held += head
                yield from self._whole()
            self.held = data
        elif self.held is None:
            return
        else:
            self.held += data
        yield from self._whole()

    def _whole(self):
        while self.held and self.held[0] != 0xFF and len(self.held) >= 3:
            size = 3 + (int.from_bytes(self.held[1:3], "big") & 0x0FFF)
            if len(self.held) < size:
                return
            section, self.held = self.held[:size], self.held[size:]
            if crc32_mpeg(section):
                raise ValueError("a broken program table")
            yield section


def _programs(section: bytes) -> dict[int, int]:
    """program -> packet identifier of its map, without the network's."""
    entries = section[8:-4]
    pairs = [(int.from_bytes(entries[i : i + 2], "big"), int.from_bytes(entries[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(entries) - 3, 4)]
    return {program: pid for program, pid in pairs if program}


def _elementary(section: bytes) -> list[tuple[int, int]]:
    """(stream type, packet identifier) of a map, descriptors skipped."""
    at, end, out = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF), len(section) - 4, []
    while at + 5 <= end:
        out.append((section[at], int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF))
        at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0x0FFF)
    return out


def _stream_pid(data: bytes) -> int:
    """The packet identifier of the first program's stream: private data before any other."""
    sections: dict[int, _Sections] = {0: _Sections()}
    for p in _packets(data, Stream()):
        if p.pid not in sections:
            continue
        for section in sections[p.pid].add(p):
            if not section[5] & 1:
                continue  # not yet in force
            if section[0] == 0 and p.pid == 0:
                for pid in _programs(section).values():
                    sections.setdefault(pid, _Sections())
            elif section[0] == 2 and (streams := _elementary(section)):
                return next((pid for kind, pid in streams if kind == 6), streams[0][1])
    raise ValueError("no program in the stream")


def demux(data: bytes) -> Stream:
    """Read a stream back; broken tables, a stream without a program, packets out of step and short units raise, gaps in
    counters are counted."""
    if len(data) % PACKET:
        raise ValueError("not whole packets")
    out = Stream(packets=len(data) // PACKET)
    if not data:
        return out
    es_pid = _stream_pid(data)
    parts: list[bytes] = []
    units: list[bytes] = []
    points: list[tuple[int, int]] = []
    tables_at = None

    def close():
        if not parts:
            return
        pes = b"".join(parts)
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or (size and len(pes) != size + 6):
            raise ValueError("a broken elementary packet")
        time = None
        if pes[7] & 0x80:
            p = pes[9:14]
            time = (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1
        out.timestamps.append(time)
        units.append(pes[9 + pes[8] :])
        parts.clear()

    for p in _packets(data, out):
        if p.pid == 0 and p.start:
            tables_at = p.number
        elif p.pid == es_pid:
            if p.start:
                close()
                if p.random_access:
                    points.append((len(units), p.number if tables_at is None else tables_at))
            if p.payload is not None and (p.start or parts):
                parts.append(p.payload)
            tables_at = None
    close()
    out.payload = b"".join(units)
    out.access_points = [(out.timestamps[k], n) for k, n in points]
    return out


def padded(text: str | None, to: int = 64) -> tuple[int, bytes]:
    """Bytes of a text and its payload: zeros up to a positive multiple."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\0" * (-len(raw) % to if raw else to)


_INDEX = "timestamps array<bigint>, access_points array<struct<time:bigint,packet:bigint>>"


def _indexed(streams: list[Stream]) -> list[pa.Array]:
    point = pa.struct([("time", pa.int64()), ("packet", pa.int64())])
    return [pa.array([s.timestamps for s in streams], pa.list_(pa.int64())), pa.array([[{"time": t, "packet": n} for t, n in s.access_points] for s in streams], pa.list_(point))]


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stream) and its index (timestamps, access_points) of every whole text, written to the
    shared folder and read again."""
    small_batches(docs.sparkSession)

    def store(batches):
        for batch in batches:
            pairs = [padded(t) for t in batch.column(1).to_pylist()]
            streams = [mux(p) for _, p in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array(streams, pa.binary()), *_indexed([index(len(p)) for _, p in pairs])], ["doc_id", "n_bytes", "media", "timestamps", "access_points"])

    stored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, f"doc_id long, n_bytes long, media binary, {_INDEX}")
    return written(stored, "media", "zstd")


def index(size: int, unit: int = UNIT, rap_every: int = RAP_EVERY) -> Stream:
    """Timestamps and random-access points of a payload of so many bytes, as `mux` lays them out."""
    out, packet = Stream(), 0
    for number, at in enumerate(range(0, size, unit)):
        out.timestamps.append(TICKS * number % 2**33)
        if number % rap_every == 0:
            out.access_points.append((out.timestamps[-1], packet))
            packet += 2
        # a packet carries 184 bytes, the first one 8 fewer; a unit has 14 bytes of its own
        packet += -(-(min(unit, size - at) + 14 + 8) // (PACKET - 4))
    return out


def read_media(media: DataFrame) -> DataFrame:
    """From the stored streams alone: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 64 bytes),
    media_bytes, media_sha256, feature, timestamps and access_points. An index that doesn't fit its stream raises."""

    def read(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "access_points"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows, streams = [], []
            for data in batch.column("media").to_pylist():
                s = demux(data)
                feature = f"packets={s.packets};units={len(s.timestamps)};pts={s.timestamps[0]}-{s.timestamps[-1]};raps={len(s.access_points)};errors={s.errors}"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                streams.append(s)
            found = _indexed(streams)
            if any(a.to_pylist() != batch.column(n).to_pylist() for a, n in zip(found, names[-2:])):
                raise ValueError("an index doesn't fit its stream")
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types)), *found], names)

    return media.mapInArrow(read, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {_INDEX}")


def media_features(docs: DataFrame) -> DataFrame:
    """Store each whole text as a transport stream with its index and read it back.

    Null and empty texts are 64 zero bytes. Repeated rows and null ids give a row each; equal texts give equal
    values; other columns are ignored; an empty table gives no rows."""
    return read_media(store_media(docs))
