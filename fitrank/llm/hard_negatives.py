"""Hard negatives by blocked dense products.

Anchors come in groups of a bounded size that are broadcast, candidates in blocks as they are read; a task multiplies
each block with each anchor block of its group in float64, which is exact while every inner product stays below 2 ** 53
(64-bit integers beyond). First pass: each task keeps the best rows of the anchor's label, a few an anchor, and those of
all tasks are merged. Each positive then opens a window of scores below its own. Second pass: each task keeps the best
rows of other labels within every window, and those of all tasks are merged. What is moved is a few rows an anchor and
task; candidates stay where they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written
from .vector_search import NO_ID, clean_vectors

#: Bytes of anchors that are broadcast at once; further groups have passes of their own.
GROUP_BYTES = 16 << 20
#: Rows of a block of anchors and of candidates; their product takes 8 MB.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 512, 2048
#: Stands below every score.
LOWEST = np.iinfo(np.int64).min


class BestRows:
    """The k best (score, smaller id first) of each of n lists; an update names rows of a list at most once."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), LOWEST, np.int64)
        self.ids = np.full((n, k), NO_ID, np.int64)

    def add(self, first: int, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """scores and wanted: (lists from `first` on, candidates). Only rows as good as the list's last are looked at."""
        own_scores, own_ids = self.scores[first : first + len(scores)], self.ids[first : first + len(scores)]
        who, what = np.nonzero(wanted & (scores >= own_scores[:, -1:]))
        if not len(who):
            return
        k = self.scores.shape[1]
        lists, counts = np.unique(who, return_counts=True)
        all_lists = np.concatenate([np.repeat(lists, k), who])
        all_scores = np.concatenate([own_scores[lists].ravel(), scores[who, what].astype(np.int64)])
        all_ids = np.concatenate([own_ids[lists].ravel(), ids[what]])
        order = np.lexsort((all_ids, ~all_scores, all_lists))  # ~ turns the order around and cannot overflow
        starts = np.concatenate([[0], np.cumsum(counts + k)[:-1]])
        best = order[starts[:, None] + np.arange(k)]
        own_scores[lists], own_ids[lists] = all_scores[best], all_ids[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, id, score) of all that was found."""
        there = self.ids != NO_ID
        return np.nonzero(there)[0], self.ids[there], self.scores[there]


def labelled_vectors(rows: DataFrame, label: Column, scale: int = 256, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """vec_id, label, vector (floor(scale * x)) of the rows that take part: those with an id, a label and a usable vector.
    Rows of one id are one row, that of the greatest label, then vector."""
    there = rows.where(label.isNotNull())
    clean = written(clean_vectors(there, scale, id_name, vector_name, [label.cast("long").alias("label")]), "labelled")
    if clean.groupBy("vec_id").count().where("count > 1").isEmpty():  # ids alone are shuffled for this
        return clean.select("vec_id", "label", "vector")
    return written(clean.groupBy("vec_id").agg(F.max(F.struct("label", "vector")).alias("one")).select("vec_id", "one.label", "one.vector"), "labelled")


def _parts(batch: pa.RecordBatch, dim: int, kind: type):
    """ids, labels and vectors of a batch's candidates, a block at a time."""
    for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
        part = batch.slice(at, CANDIDATE_BLOCK)
        vectors = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind)
        yield part.column(0).to_numpy(), part.column(1).to_numpy(), vectors


def _positives(candidates: DataFrame, group: dict, k: int) -> DataFrame:
    """anchor_id, vec_id, score: at least the k best rows of the anchor's label, by task."""
    known = candidates.sparkSession.sparkContext.broadcast(group)

    def find(batches):
        g = known.value
        best = BestRows(len(g["ids"]), k)
        for batch in batches:
            for ids, labels, vectors in _parts(batch, g["vectors"].shape[1], g["vectors"].dtype):
                for a in range(0, len(g["ids"]), ANCHOR_BLOCK):
                    one = slice(a, a + ANCHOR_BLOCK)
                    same = (g["labels"][one, None] == labels) & (g["ids"][one, None] != ids)
                    best.add(a, g["vectors"][one] @ vectors.T, same, ids)
        who, ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(g["ids"][who]), pa.array(ids), pa.array(scores)], ["anchor_id", "vec_id", "score"])

    return candidates.mapInArrow(find, "anchor_id long, vec_id long, score long")


def _negatives(candidates: DataFrame, group: dict, k: int, percent: int) -> DataFrame:
    """anchor_id, positive_score, vec_id, score: at least the k best rows of other labels in each window, by task.
    group["tops"]: each anchor's distinct positive scores, in columns, absent ones LOWEST."""
    known = candidates.sparkSession.sparkContext.broadcast(group)

    def find(batches):
        g = known.value
        tops = g["tops"]
        # an absent window, or one below a negative score, is empty: its floor is above its top
        full = np.maximum(tops, 0)
        floors = full // 100 * percent + -(-(full % 100) * percent // 100)
        best = [BestRows(len(tops), k) for _ in range(tops.shape[1])]
        for batch in batches:
            for ids, labels, vectors in _parts(batch, g["vectors"].shape[1], g["vectors"].dtype):
                for a in range(0, len(tops), ANCHOR_BLOCK):
                    one = slice(a, a + ANCHOR_BLOCK)
                    scores = g["vectors"][one] @ vectors.T
                    other = g["labels"][one, None] != labels
                    for w, found in enumerate(best):
                        found.add(a, scores, other & (scores <= tops[one, w, None]) & (scores >= floors[one, w, None]), ids)
        for w, found in enumerate(best):
            who, ids, scores = found.rows()
            yield pa.RecordBatch.from_arrays([pa.array(g["ids"][who]), pa.array(tops[who, w]), pa.array(ids), pa.array(scores)], ["anchor_id", "positive_score", "vec_id", "score"])

    return candidates.mapInArrow(find, "anchor_id long, positive_score long, vec_id long, score long")


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _group(anchors: DataFrame, dim: int, kind: type) -> dict:
    """A group of anchors as arrays, in order of their ids; its size is bounded by GROUP_BYTES."""
    rows = anchors.orderBy("vec_id").toArrow()
    column = rows.column("vector").combine_chunks()
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return {"ids": rows.column("vec_id").to_numpy(), "labels": rows.column("label").to_numpy(), "vectors": vectors.astype(kind)}


def _tops(ids: np.ndarray, anchors: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Each anchor's distinct positive scores, in k columns; anchors come in order."""
    tops = np.full((len(ids), k), LOWEST, np.int64)
    there, first, of = np.unique(anchors, return_index=True, return_inverse=True)
    tops[np.searchsorted(ids, there)[of], np.arange(len(anchors)) - first[of]] = scores
    return tops


def mine(rows: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its `positives` best other rows of the same label; to each belong the `negatives` best rows
    of other labels whose score is at least `percent` hundredths of the positive's and not above it (a negative positive
    score has none). Scores are integer inner products, ties go to the smaller id. is_anchor is a condition on vec_id;
    label is a column of rows. Rows with a null id or label, a null or empty vector or a null or non-finite component take
    no part; rows of one id are one row, that of the greatest label, then vector; only vectors of equal length meet.
    Inner products must fit 64-bit integers. Other columns are ignored; an empty table gives no rows."""
    spark = rows.sparkSession
    small_batches(spark)
    known = labelled_vectors(rows, label, scale)
    wide = F.size("vector").alias("dim")
    largest = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))
    sizes = known.groupBy(wide).agg(F.max(largest).alias("largest"), F.sum(is_anchor.cast("long")).alias("anchors")).where("anchors > 0")
    found = None
    for size in sorted(sizes.collect(), key=lambda r: r["dim"]):  # a row a vector length
        kind = np.float64 if size["largest"] ** 2 * size["dim"] < 2**53 else np.int64
        candidates = known.where(F.size("vector") == size["dim"])
        groups = -(-size["anchors"] * size["dim"] * 8 // group_bytes)
        for number in range(groups):
            own = candidates.where(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == number))
            group = _group(own, size["dim"], kind)
            if len(group["ids"]):
                near = written(_first(_positives(candidates, group, positives), ["anchor_id"], positives), "positives")
                scores = near.select("anchor_id", "score").distinct().orderBy("anchor_id", "score").toArrow()  # `positives` an anchor of the group
                tops = _tops(group["ids"], scores.column("anchor_id").to_numpy(), scores.column("score").to_numpy(), positives)
                below = _first(_negatives(candidates, group | {"tops": tops}, negatives, percent), ["anchor_id", "positive_score"], negatives)
                pairs = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
                below = below.select("anchor_id", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
                part = pairs.join(below, ["anchor_id", "positive_score"])
                found = part if found is None else found.union(written(part, "mined"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found.select(columns)
