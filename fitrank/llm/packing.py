"""Vector best-fit packing of documents into training sequences.

Pieces of equal length are alike, so packing needs only the histogram of lengths, which has at most
`capacity` entries whatever the input: the plan is made from it on the driver and covers all rows.
Pieces that fill a sequence take one each and need no plan. Lengths are placed longest first. Open sequences are kept as runs of like ones; of the runs whose residual
tokens, documents and attention cost all admit the piece, the one with the largest weighted dot product of
normalised demand and spent capacity (or the smallest residual norm) takes it, as many at once as the run
and the length allow. Each placement is one line of the plan: ranks of a length go to a run of sequences.
Rows then get their rank within their length and look up their line.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenization as T
from .shared import small_batches, written


#: Blocks of a length that one task adds up.
MOST_BLOCKS = 4096


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; attention is the sum of squared lengths (None: tokens squared,
    which tokens alone imply). weights: of tokens, documents and attention in the score."""

    tokens: int = 4096
    documents: int = 4096
    attention: int | None = None
    weights: tuple = (1.0, 0.05, 0.25)
    rule: str = "dot"

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention or self.tokens**2], np.float64)


def plan_packing(histogram: dict[int, int], limits: Limits = Limits()) -> np.ndarray:
    """Lines (length, first rank, sequences, pieces a sequence, first sequence, offset) that place
    every piece of the histogram."""
    cap, weights = limits.vector, np.asarray(limits.weights) / limits.vector**2
    if any(n > 0 and (length > cap[0] or length * length > cap[2]) for length, n in histogram.items()) or cap[1] < 1:
        raise ValueError("a piece exceeds a sequence's capacity")
    room = np.zeros((1024, 3))
    first = np.zeros(1024, np.int64)
    count = np.zeros(1024, np.int64)
    runs = sequences = 0
    lines: list[tuple] = []

    def open_run(residual, at, n):
        nonlocal room, first, count, runs
        if runs == len(first):
            room, first, count = np.vstack([room, np.zeros_like(room)]), np.append(first, np.zeros_like(first)), np.append(count, np.zeros_like(count))
        room[runs], first[runs], count[runs] = residual, at, n
        runs += 1

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left, rank = int(histogram[length]), 0
        demand = np.array([length, 1, length * length], np.float64)
        while left:
            fits = np.flatnonzero((room[:runs] >= demand).all(axis=1))
            if len(fits):
                rest = room[fits]
                score = ((cap - rest) * demand * weights).sum(axis=1) if limits.rule == "dot" else -(((rest - demand) ** 2) * weights).sum(axis=1)
                best = fits[np.argmax(score)]
                deep = int(min((room[best] // demand).min(), max(1, left // count[best])))
                n = int(min(count[best], left // deep if left >= count[best] else left))
                residual, at, have = room[best].copy(), int(first[best]), int(count[best])
            else:
                deep = int((cap // demand).min())
                deep = min(deep, left)
                n = left // deep
                residual, at, have, best = cap.copy(), sequences, n, None
                sequences += n
            lines.append((length, rank, n, deep, at, int(cap[0] - residual[0])))
            rank, left = rank + n * deep, left - n * deep
            after = residual - deep * demand
            if best is None:
                if after[0] >= 1 and after[1] >= 1:
                    open_run(after, at, n)
            else:
                if n < have:
                    open_run(residual, at + n, have - n)
                room[best], count[best] = after, n
                if after[0] < 1 or after[1] < 1:
                    runs -= 1
                    room[best], first[best], count[best] = room[runs], first[runs], count[runs]
    return np.array(lines, np.int64).reshape(-1, 6)


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1, position: str | None = None) -> DataFrame:
    """Encode whole texts, append end_id, cut only what is longer than `capacity`:
    row, doc_id, piece, start, length, ids_crc32, full (for a piece that fills a sequence, a negative number of its own)
    and, where a column is named, the document's training position."""
    small_batches(docs.sparkSession)
    end = np.uint32(end_id).tobytes()
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "full"] + ["position"] * bool(position)
    types = {"piece": pa.int32(), "position": pa.float64()}

    def cut(batches):
        encode = T.coder(path, T.WordCoder).encode
        row = TaskContext.get().partitionId() << 40
        full = -1 - row
        for batch in batches:
            out: list = []
            for doc_id, text, *at in zip(*(c.to_pylist() for c in batch.columns)):
                row += 1
                ids = memoryview((encode(text) if text else b"") + end)
                n = len(ids) // 4
                for k, a in enumerate(range(0, n, capacity)):
                    b = min(n, a + capacity)
                    whole = b - a == capacity
                    full -= whole
                    out.append((row, doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), full if whole else None, *at))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, columns)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(position).cast("double").alias("position")] if position else []))
    return rows.mapInArrow(cut, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, full long" + ", position double" * bool(position))


def _ranked(pieces: DataFrame, histogram: dict[int, int], block: int) -> DataFrame:
    """rank of each piece within its length, from 0, in training order where pieces have a position. A length is dealt
    into blocks of about `block` rows (stretches of training time, or by hash) and at most MOST_BLOCKS of them, so that
    neither its rows nor its blocks meet in one task."""
    counts = [(k, min(MOST_BLOCKS, -(-n // block))) for k, n in sorted(histogram.items())]  # a row a length, so bounded by the capacity
    wide = F.broadcast(pieces.sparkSession.createDataFrame(counts, "length long, wide long"))
    # a null doc_id is a value like any other
    by_hash = F.pmod(F.xxhash64("row", "piece"), F.col("wide"))
    timed = ["position"] if "position" in pieces.columns else []
    if timed:
        stretch = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "position")) * F.col("wide"))
        by_hash = F.when(F.col("position").isNull(), by_hash).otherwise(F.least(stretch, F.col("wide") - 1))
    dealt = pieces.join(wide, "length").withColumn("block", by_hash).drop("wide")
    upto = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy(*timed, "row", "piece")
    return dealt.withColumn("place", F.row_number().over(within)).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("place") - 1)


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1, block: int = 128, position: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each document's pieces and their places.

    `position` names a column with documents' training positions in [0, 1]: pieces of equal length then take their
    places in this order, which costs no sequence, and every piece keeps its position as a last column.

    Null and empty texts are one token (the end id). Repeated rows and null ids are documents of their
    own. Other columns are ignored; an empty table gives no rows."""
    pieces = written(cut_pieces(docs, path, limits.tokens, end_id, position), "pieces")
    rest = pieces.where("full is null")
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}
    lines = plan_packing(histogram, limits)
    order = np.lexsort((lines[:, 1], lines[:, 0]))
    plan = docs.sparkSession.sparkContext.broadcast(lines[order])
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    timed = ["position"] if position else []

    def place(frames):
        length, rank, _, deep, at, offset = plan.value.T
        key = (length << 40) + rank
        for f in frames:
            line = np.searchsorted(key, (f["length"].to_numpy() << 40) + f["rank"].to_numpy(), side="right") - 1
            i = f["rank"].to_numpy() - rank[line]
            f["sequence_id"] = at[line] + i // deep[line]
            f["offset"] = offset[line] + i % deep[line] * length[line]
            yield f[[*own, "sequence_id", "offset", *timed]]

    ranked = _ranked(rest, histogram, block).select(*own, "rank", *timed)
    placed = ranked.mapInArrow(_by_frame(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", position double" * bool(position))
    alone = pieces.where("full is not null").select(*own, F.col("full").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *timed)
    return placed.unionByName(alone)


def in_training_order(packed: DataFrame) -> DataFrame:
    """Packed pieces with a position, by sequence: a sequence stands where its first piece does (sequence_position, added),
    and sequences are range-sorted by it. A sequence's pieces are few, as its capacity bounds them."""
    rows = written(packed, "packed")
    first = rows.groupBy("sequence_id").agg(F.min("position").alias("sequence_position"))
    order = ["sequence_position", "sequence_id"]
    return rows.join(first, "sequence_id").select(*packed.columns, "sequence_position").repartitionByRange(*order).sortWithinPartitions(*order, "offset")


def _by_frame(f):
    """Frames in, batches out; ids that may be null stay out of pandas' floats."""

    def run(batches):
        for batch in batches:
            frame = pd.DataFrame({n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "doc_id"})
            frame["doc_id"] = batch.column("doc_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            for out in f([frame]):
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run
