"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by page_id into shards, one gzip member each; a shard rolls to a new file once its compressed
size reaches `roll_bytes`. The number of shards and their bounds follow from the rows alone (exact counts and ids chosen
by hash), whatever the partitions, so that every run writes the same files. Headers and digests are made anew from the
payload. Files are written under temporary names and renamed to names that follow from their place, so a repeated task
writes the same bytes to the same name; the manifest, written when all are in place, is the commit: readers open only
what it lists and check each file's digest. Of equal payloads (by SHA-256 and size) of at least `least_bytes`, the
largest page_id holds the response, the others revisit it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import get_file, nb_partitions, put_file, shared_path, small_batches, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits that may be broadcast: 1 million are some 100 MB.
BROADCAST_ROWS = 1_000_000
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(page_id, url, payload: bytes | None, digest: str, size: int, refers_to, date: str) -> bytes:
    """One record. A revisit (payload None) holds the HTTP header alone; extension headers carry what readers need to
    tell pages apart."""
    urn = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}')}>"
    block = _HTTP % size + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    lines.append("WARC-Target-URI: " + (_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"))
    lines += [f"WARC-Payload-Digest: {_b32(digest)}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), f"X-Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of an archive; a block or payload
    that doesn't match its digest raises."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 16)
    while True:
        line = f.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a record")
        head = {}
        while (line := f.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = f.read(int(head["Content-Length"]))
        if f.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError("a broken record")
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
        if head["WARC-Type"] == "response":
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError("a payload doesn't match its digest")
        else:
            size = int(head["X-Payload-Length"])
        number = lambda n: int(head[n]) if n in head else None
        yield number("X-Page-Id"), size, digest, head["WARC-Type"], number("X-Refers-To-Page")


def _payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html as bytes (null: empty), digest (SHA-1), same (SHA-256), size, and place: a text that orders
    rows by page_id (null first), then by the first of their digest."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("same", F.unhex(F.sha2("html", 256))).withColumn("size", F.octet_length("html").cast("long"))
    number = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return rows.withColumn("place", F.concat(F.coalesce(number, F.lit("")), F.lit("/"), F.substring("digest", 1, 4)))


def _roles(rows: DataFrame, marks: DataFrame, least_bytes: int) -> DataFrame:
    """Payload rows with refers_to; revisits have a null html."""
    narrow = marks.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "same", "size")
    holders = narrow.groupBy("same", "size").agg(F.max("page_id").alias("holder"), F.min("page_id").alias("low")).where("low < holder").select("same", "size", "holder")
    revisits = narrow.join(holders, ["same", "size"]).where("page_id < holder").select(F.col("page_id").alias("revisit"), F.col("same").alias("as"), F.col("holder").alias("refers_to")).distinct()
    revisits = written(revisits, "revisits")
    if revisits.count() <= BROADCAST_ROWS:  # then pages are not shuffled to meet them
        revisits = F.broadcast(revisits)
    joined = rows.join(revisits, (F.col("page_id") == F.col("revisit")) & (F.col("same") == F.col("as")), "left")
    return joined.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html"))).drop("revisit", "as")


def shard_bounds(marks: DataFrame, shard_rows: int = 256, most_small: int = 256, shard_bytes: int = 256 << 20, most_shards: int = 1 << 16) -> np.ndarray:
    """Places at which shards after the first begin. Shards: one for each `shard_bytes`, but one for each `shard_rows` up
    to `most_small`, and `most_shards` at most: beyond 16 TB shards grow instead, and their files roll on as before. Bounds
    are quantiles of places chosen by a hash of the place, some 16 a shard: 2 million places of 21 bytes at most."""
    size = marks.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    shards = max(1, min(most_small, -(-size["n"] // shard_rows)), -(-(size["bytes"] or 0) // shard_bytes))
    shards = min(shards, most_shards)
    every = max(1, size["n"] // max(65536, 16 * shards))
    chosen = marks.where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).select("place").distinct().toArrow().column("place")
    places = np.sort(np.array(chosen.to_pylist(), "S21"))
    return np.unique(places[[len(places) * i // shards for i in range(1, shards)]]) if len(places) else places


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, roll_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 6, **bounds) -> DataFrame:
    """Write a record for each page, in order of page_id (null ids first), and commit the manifest, which is returned:
    part, seq, file, records, bytes, sha256. `bounds`: options of shard_bounds. Rows of one id (or none) are split by
    their digest's first four digits; rows alike in both stay in one shard."""
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches):
        part, seq, members, size = None, 0, [], 0

        def roll():
            nonlocal seq, size
            data = b"".join(members)
            file = put_file(folder, f"part-{part:06d}-{seq:06d}.warc.gz", data)
            row = {"part": part, "seq": seq, "file": file, "records": len(members), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
            members.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for shard, page_id, url, html, digest, n, refers_to in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if shard != part:
                    if members:
                        yield roll()
                    part, seq = shard, 0
                record = record_bytes(page_id, url, html, digest, n, refers_to, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                members.append(packer.compress(record) + packer.flush())
                size += len(members[-1])
                if size >= roll_bytes:
                    yield roll()
        if members:
            yield roll()

    spark = pages.sparkSession
    small_batches(spark)
    rows = _payloads(pages)
    marks = written(rows.select("page_id", "same", "size", "place"), "digests")
    starts = shard_bounds(marks, **bounds)
    shards, tasks = len(starts) + 1, nb_partitions(spark)
    begin = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def shard_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begin.value, place.to_numpy("S21"), side="right"))

    placed = _roles(rows, marks, least_bytes).withColumn("shard", shard_of("place"))
    # a shard is one task's; its neighbours are in the same or the next
    dealt = placed.repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / shards).cast("int"))
    ordered = dealt.sortWithinPartitions("shard", "page_id", "same", "url").select("shard", "page_id", "url", "html", "digest", "size", "refers_to")
    return written(ordered.mapInArrow(write, "part long, seq long, file string, records long, bytes long, sha256 string"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (bare lower-case hex SHA-1), record_type and refers_to, from the files that
    the manifest lists."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches):
        for batch in batches:
            for file, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = get_file(file)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{file} doesn't match the manifest")
                columns = list(zip(*read_records(data)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    files = manifest.select("file", "sha256").repartition(nb_partitions(manifest.sparkSession))
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back.

    A null html is an empty payload, a null url a made-up URN; rows without page_id are responses and are never
    referred to; equal rows of one page_id are responses each. Other columns are ignored; an empty table writes no
    file and gives no rows."""
    return read_archives(write_archives(pages, shared_path(pages.sparkSession, "warc"), **options))
