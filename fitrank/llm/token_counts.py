"""Token counts: pieces are counted once per distinct pre-token and joined to frequencies.

Texts are parted into the tokenizer's own pre-tokens (what only the library can part is kept as one). Counts of the
`head` most frequent pre-tokens of a sample of documents (both bounds are parameters; they only decide which way a
pre-token takes, never the result) travel to the workers as a table of bounded size. Frequencies of all others are
gathered by pre-token, compressed and dealt into buckets by a hash of it; in its bucket each distinct one is counted once
and joined to its documents' frequencies. Sums by document remain. Ids are never materialised.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenization as T
from .shared import nb_partitions, small_batches, written

#: Text that one bucket is laid out for, and the most buckets that are laid out.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 1 << 16
#: Pre-tokens whose pieces a bucket's task remembers at once; beyond it forgets, and counts again what comes back.
REMEMBERED = 1_000_000
#: Bytes of names that a task gathers before it hands on.
GATHERED_BYTES = 64 << 20
#: Entries of sums that a task holds before it adds them up.
HELD = 1_000_000


def _parts(unit: str) -> list[str]:
    """Pre-tokens of a unit, or the unit where only the library can part it."""
    return [unit] if (parts := T.pre_tokens(unit)) is None else parts


class _Split(T._Memory):
    """unit -> pieces of its pre-tokens where all are in the head, else (pieces of those that are, the others)."""

    def __init__(self, head: dict, led: str):
        def split(unit):
            parts = _parts(led + unit)
            tail = tuple(p for p in parts if p not in head)
            pieces = sum(head[p] for p in parts if p in head)
            return (pieces, tail) if tail else pieces

        super().__init__(split)


def _counted(parts: list[str], path: str) -> list[int]:
    """Pieces of each, by the library."""
    return [len(e.ids) for e in T.library(path).encode_batch_fast(parts, add_special_tokens=False)]


def head_parts(docs: DataFrame, path: str, size: int, sample_docs: int, every: int) -> dict[str, int]:
    """The most frequent pre-tokens of about `sample_docs` documents (every `every`-th by hash), `size` at most (ties by
    text), and their pieces."""
    pairs = pa.schema([("part", pa.string()), ("n", pa.int64())])

    def parts(batches):
        for batch in batches:
            units: Counter = Counter()
            for text in batch.column(0).to_pylist():
                first, *rest = T.pieces(text)
                units.update([first])
                units.update([" " + u for u in rest])
            n: Counter = Counter()
            for u, k in units.items():
                for p in _parts(u):
                    if len(p) <= T.LONG:
                        n[p] += k
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], schema=pairs)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_counted(batch.column(0).to_pylist(), path), pa.int64())], ["part", "pieces"])

    some = docs.where("text <> ''").where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    sums = some.mapInArrow(parts, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).where("n > 1")
    common = written(sums.orderBy(F.desc("n"), "part").limit(size).select("part"), "head")
    return {r["part"]: r["pieces"] for r in common.repartition(nb_partitions(docs.sparkSession)).mapInArrow(count, "part string, pieces long").collect()}


class Tail:
    """Per-document frequencies of pre-tokens outside the head, gathered by pre-token and dealt into buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.numbers = buckets, {}
        self.clear()

    def clear(self):
        self.numbers.clear()
        self.unit, self.row, self.freq, self.bytes = array("I"), array("q"), array("I"), 0

    def add(self, row: int, freq: dict) -> None:
        numbers = self.numbers
        for u, n in freq.items():
            number = numbers.setdefault(u, len(numbers))
            if number == len(numbers) - 1:
                self.bytes += len(u)
            self.unit.append(number)
            self.row.append(row)
            self.freq.append(n)

    def blobs(self):
        """(bucket, blob): the pre-tokens of a bucket, once each, with the rows and frequencies of each."""
        if not self.unit:
            return
        names = [u.encode("utf-8", "surrogatepass") for u in self.numbers]
        bucket = np.fromiter((zlib.crc32(u) % self.buckets for u in names), np.int64, len(names))
        unit, row, freq = (np.array(x) for x in (self.unit, self.row, self.freq))
        first = int(row.min())
        order = np.lexsort((row, unit, bucket[unit]))
        unit, row, freq = unit[order], (row[order] - first).astype("<u4"), freq[order].astype("<u4")
        ends = np.flatnonzero(np.diff(bucket[unit], append=-1)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            own, n = np.unique(unit[a:b], return_counts=True)
            text = [names[i] for i in own]
            head = struct.pack("<qII", first, len(own), b - a) + np.array([len(t) for t in text], "<u4").tobytes() + n.astype("<u4").tobytes()
            yield int(bucket[own[0]]), zlib.compress(head + row[a:b].tobytes() + freq[a:b].tobytes() + b"".join(text), 1)


def open_blob(blob: bytes):
    """(pre-tokens, postings of each, rows, frequencies)."""
    data = zlib.decompress(blob)
    first, n, m = struct.unpack_from("<qII", data)
    sizes, counts, rows, freq = (np.frombuffer(data, "<u4", k, at) for k, at in ((n, 16), (n, 16 + 4 * n), (m, 16 + 8 * n), (m, 16 + 8 * n + 4 * m)))
    ends = 16 + 8 * n + 8 * m + np.cumsum(sizes, dtype=np.int64)
    return [data[e - s : e].decode("utf-8", "surrogatepass") for s, e in zip(sizes.tolist(), ends.tolist())], counts, rows.astype(np.int64) + first, freq.astype(np.int64)


def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of each."""
    found, place = np.unique(rows, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, n)
    return found, total


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, head: int = 1 << 17, sample_docs: int = 10_000, gathered: int = 2_000_000) -> DataFrame:
    """Tokens of every row's whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows and null ids give a row each. Other
    columns are ignored. An empty table gives no rows. A task gathers `gathered` frequencies at most before it
    hands them on."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    every = max(1, -(-size["n"] // sample_docs))
    known = spark.sparkContext.broadcast(head_parts(docs, path, head, sample_docs, every))
    buckets = max(nb_partitions(spark), min(-(-(size["bytes"] or 0) // BUCKET_BYTES), MOST_BUCKETS))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])

    def frequencies(batches):
        led, bare = _Split(known.value, " "), _Split(known.value, "")
        row, tail = TaskContext.get().partitionId() << 40, Tail(buckets)

        def hand_on():
            pairs = list(tail.blobs())
            tail.clear()
            for at in range(0, len(pairs), 64):
                none = pa.nulls(len(pairs[at : at + 64]), pa.int64())
                b, blob = zip(*pairs[at : at + 64])
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(b, pa.int64()), pa.array(blob, pa.binary())], schema=schema)

        for batch in batches:
            rows, sizes, sums = [], [], []
            for text in batch.column(1).to_pylist():
                row += 1
                units = T.pieces(text) if text else [""]
                found = [bare[units[0]], *map(led.__getitem__, units[1:])]
                others = [x for x in found if type(x) is tuple]
                if others:
                    total = sum(x for x in found if type(x) is int) + sum(x for x, _ in others)
                    tail.add(row, Counter(chain.from_iterable(x for _, x in others)))
                else:
                    total = sum(found)
                rows.append(row)
                sizes.append(len(text.encode("utf-8")) if text else 0)
                sums.append(total)
                if len(tail.unit) >= gathered or tail.bytes >= GATHERED_BYTES:
                    yield from hand_on()
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), none, pa.nulls(len(rows), pa.binary())], schema=schema)
        yield from hand_on()

    def join_pieces(batches):
        """Blobs of a bucket meet here: every pre-token is counted when it first comes up and joined to all of its rows."""
        pieces, of = {}, None
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != of or len(pieces) > REMEMBERED:
                    pieces, of = {}, bucket
                parts, counts, rows, freq = open_blob(blob)
                new = [p for p in parts if p not in pieces]
                pieces.update(zip(new, _counted(new, path)))
                found, total = _summed(rows, np.repeat([pieces[p] for p in parts], counts) * freq)
                sums = zlib.compress(found.astype("<i8").tobytes() + total.astype("<i8").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(found[0]) >> 40], pa.int64()), pa.array([sums], pa.binary())], ["part", "sums"])

    def sum_by_row(batches):
        """Sums of a part (the rows that one task read) come back from all buckets and become one row a document."""
        of, held, size = None, [], 0

        def added():
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        def done():
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], ["row", "n"])
                held.clear()

        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != of:
                    yield from done()
                    of, size = part, 0
                both = np.frombuffer(zlib.decompress(sums), "<i8").astype(np.int64)
                held.append((both[: len(both) // 2], both[len(both) // 2 :]))
                size += len(both) // 2
                if size > HELD:
                    held[:], size = [added()], 0
        yield from done()

    gathered_rows = written(docs.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, n long, bucket long, blob binary"), "frequencies")
    blobs = gathered_rows.where("bucket is not null").select("bucket", "blob").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    sums = blobs.mapInArrow(join_pieces, "part long, sums binary").repartition(buckets, "part").sortWithinPartitions("part")
    tail = sums.mapInArrow(sum_by_row, "row long, n long").select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), "n")
    rows = gathered_rows.where("bucket is null").select("row", "doc_id", "n_bytes", "n").union(tail)
    counted = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
