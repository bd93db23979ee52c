"""Exact top-k inner-product search by KD-trees per shard.

Rows are dealt into shards by space, as the top levels of one tree would: medians of the widest dimension of a bounded
sample; cells with more rows than a shard holds are dealt on by a hash of the id. Each shard becomes a tree: the widest
dimension is split at its median until a leaf holds `leaf` vectors, and every node keeps the tight box and the smallest
id of its vectors. Trees are written once to the shared folder; their root boxes and places are the table of trees.

No vector of a box scores higher with query q than sum(max(q * low, q * high)). Queries come in blocks, neighbours in
space together. A task takes one block through a list of trees, best root bound first, and opens a tree only if its root
may better the k-th best (score, id) of some query; within a tree it goes on best bound first. The k-th best is passed on
from tree to tree. Root boxes are files of some RUN_TREES trees; what is moved is the rows, once, and a line of two file
names for each block and box file. Scores are exact integers.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import get_file, nb_partitions, put_file, shared_path, small_batches, written

NO_ID = np.iinfo(np.int64).max
#: Below every score that is exact as a double; 64-bit integers have their own least.
LOWEST = -(2**62)
#: Trees of a box file, some 1 MB in 64 dimensions.
RUN_TREES = 1024
#: Box files whose names may be broadcast, some 20 MB; they stand for 10 ** 8 trees.
BROADCAST_FILES = 100_000
#: Vector lengths that get cells of their own; rows of all others are dealt by a hash alone.
MOST_LENGTHS = 64


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = 128) -> dict:
    """The tree's nodes, an array for each of their properties; left and right are -1 at a leaf. Equal vectors
    stay one leaf."""
    order = np.arange(len(ids))
    low, high, least, span = [], [], [], []
    children: tuple[list, list] = ([], [])
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        rows = vectors[order[a:b]]
        if parent >= 0:
            children[side][parent] = len(low)
        low.append(rows.min(axis=0))
        high.append(rows.max(axis=0))
        least.append(ids[order[a:b]].min())
        for c in children:
            c.append(-1)
        span.append((a, b))
        wide = int(np.argmax(high[-1] - low[-1]))
        if b - a > leaf and high[-1][wide] > low[-1][wide]:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, wide], half)]
            me = len(low) - 1
            todo += [(a + half, b, me, 1), (a, a + half, me, 0)]
    left, right = map(np.array, children)
    return {"ids": ids[order], "vectors": vectors[order], "low": np.array(low), "high": np.array(high), "least": np.array(least), "left": left, "right": right, "span": np.array(span)}


class Best:
    """The k best (score, smaller id first) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.lowest = LOWEST if queries.dtype.kind == "f" else -np.iinfo(np.int64).max
        self.scores = np.full((len(ids), k), self.lowest, queries.dtype)
        self.found = np.full((len(ids), k), NO_ID)

    def may_gain(self, bound: np.ndarray, least: int) -> np.ndarray:
        last, last_id = self.scores[:, -1], self.found[:, -1]
        return (bound > last) | ((bound == last) & (least < last_id))

    def add(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.queries[who] @ vectors.T
        own = self.ids[who][:, None] == ids[None, :]
        if own.any():
            scores[own] = self.lowest
        all_scores = np.hstack([self.scores[who], scores])
        all_ids = np.hstack([self.found[who], np.where(own, NO_ID, ids[None, :])])
        cut = all_scores.shape[1] - self.k
        # drop only what is below the k-th score: ties stay for the ids to decide
        kth = np.partition(all_scores, cut, axis=1)[:, cut]
        width = int((all_scores >= kth[:, None]).sum(axis=1).max())
        if width < all_scores.shape[1]:
            near = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
            all_scores, all_ids = np.take_along_axis(all_scores, near, 1), np.take_along_axis(all_ids, near, 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[who], self.found[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def walk(self, tree: dict) -> None:
        """Best bound first over one tree, for the whole block."""
        positive, negative = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        bound = lambda node: positive @ tree["high"][node] + negative @ tree["low"][node]
        heap = [(-float(bound(0).max()), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            bounds = bound(node)
            gain = self.may_gain(bounds, tree["least"][node])
            if not gain.any():
                continue
            if tree["left"][node] < 0:
                a, b = tree["span"][node]
                self.add(np.flatnonzero(gain), tree["ids"][a:b], tree["vectors"][a:b])
            else:
                for c in (tree["left"][node], tree["right"][node]):
                    heapq.heappush(heap, (-float(bound(c)[gain].max()), int(c)))


def _typed(vectors: np.ndarray, largest: int) -> np.ndarray:
    """Doubles where every inner product is exact in them, else 64-bit integers."""
    return vectors.astype(np.float64 if largest * largest * vectors.shape[1] < 2**53 else np.int64)


def clean_vectors(rows: DataFrame, scale: int = 64, id_name: str = "vec_id", vector_name: str = "embedding", keep: Sequence[Column] = ()) -> DataFrame:
    """vec_id, what `keep` says and vector: floor(scale * x) of each component as a double. Rows with a null id or vector, an empty
    vector, or a null or non-finite component take no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col(vector_name).cast("array<double>")
    usable = F.col(id_name).isNotNull() & F.col(vector_name).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)
    return rows.where(usable).select(F.col(id_name).cast("long").alias("vec_id"), *keep, F.transform(vector, lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def one_per_id(clean: DataFrame) -> DataFrame:
    """Rows of one vec_id are one vector, the greatest of them."""
    return clean.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def space_cells(sample: np.ndarray, cells: int) -> list[tuple]:
    """Nodes (dimension, median, left, right) that cut space into about `cells` cells of equally many sampled vectors; a
    child below 0 is cell -1 - child. Equal vectors stay together."""
    nodes: list[list] = []
    todo, found = [(np.arange(len(sample)), cells, -1, 2)], 0
    while todo:
        rows, want, parent, side = todo.pop()
        spread = sample[rows].max(axis=0) - sample[rows].min(axis=0) if want > 1 and len(rows) > 1 else np.zeros(1)
        me = -1 - found
        if spread.max() > 0:
            wide = int(np.argmax(spread))
            values = sample[rows, wide]
            cut = float(np.median(values))
            cut = cut if (values < cut).any() else float(values[values > cut].min())
            me = len(nodes)
            nodes.append([wide, cut, 0, 0])
            todo += [(rows[values >= cut], want // 2, me, 3), (rows[values < cut], want - want // 2, me, 2)]
        else:
            found += 1
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def cell_of(vectors: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """The cell of each vector."""
    out = np.zeros(len(vectors), np.int32)
    todo = [(0, np.arange(len(vectors)))] if nodes else []
    while todo:
        node, rows = todo.pop()
        wide, cut, *children = nodes[node]
        right = vectors[rows, wide] >= cut
        for child, own in zip(children, (rows[~right], rows[right])):
            if child < 0:
                out[own] = -1 - child
            elif len(own):
                todo.append((child, own))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def in_cells(vectors: DataFrame, shard: int, sample: int, most_cells: int) -> DataFrame:
    """vec_id, vector, dim, cell. Cells are laid out from at most about `sample` vectors of all lengths (every n-th by hash of
    its id, all of them at most 32 MB), for the most frequent lengths; the sample decides how well boxes part, never the
    result."""
    counted = vectors.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_LENGTHS).collect()
    dims, total = {r["dim"]: r["n"] for r in counted}, sum(r["n"] for r in counted)
    cells = {}
    for dim, n in dims.items():
        own = max(1, min(sample * n // total, (32 << 20) // (8 * dim * len(dims))))
        every = max(1, -(-n // own))
        some = vectors.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0)).orderBy("vec_id").select("vector").toArrow()
        cells[dim] = space_cells(_matrix(some.column(0), some.num_rows), min(most_cells, -(-n // shard))) if some.num_rows else []
    known = vectors.sparkSession.sparkContext.broadcast(cells)

    def assign(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            cell = np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                cell[own] = cell_of(_matrix(batch.column(1).take(pa.array(own)), len(own)), known.value.get(int(dim), []))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(cell)], ["vec_id", "vector", "dim", "cell"])

    return vectors.select("vec_id", "vector").mapInArrow(assign, "vec_id long, vector array<bigint>, dim int, cell int")


def _dealt(rows: DataFrame, size: int, name: str, salt: int) -> DataFrame:
    """Adds `name`: cells of up to `size` rows are put together in order, larger ones dealt by a hash of the id."""
    counts = sorted((r["dim"], r["cell"], r["n"]) for r in rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect())  # a row a cell
    table, number, room, of = [], -1, 0, None
    for dim, cell, n in counts:
        if n > size or n > room or dim != of:
            number, room, of = number + 1, size, dim
        table.append((dim, cell, number, -(-n // size)))
        number, room = number + -(-n // size) - 1, room - n
    firsts = F.broadcast(rows.sparkSession.createDataFrame(table, f"dim int, cell int, {name}_first int, {name}_wide int"))
    own = F.col(f"{name}_first") + F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(f"{name}_wide").cast("long")).cast("int")
    return rows.join(firsts, ["dim", "cell"]).withColumn(name, own).drop(f"{name}_first", f"{name}_wide")


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard: int = 8192, query_block: int = 4096, least_block: int = 128, leaf: int = 256, sample: int = 16384, most_cells: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query row with all other rows,
    ties to the smaller vec_id; fewer rows give fewer. Only vectors of equal length are compared. Rows of one id are one
    vector, the greatest of them. Inner products must fit 64-bit integers. is_query is a condition on vec_id. Other columns are ignored; an empty table gives no
    rows. A shard holds about `shard` vectors; a block of queries `query_block` at most and, to employ all tasks,
    `least_block` or more."""
    spark = rows.sparkSession
    small_batches(spark)
    clean = written(one_per_id(clean_vectors(rows, scale)), "vectors")
    placed = written(in_cells(clean, shard, sample, most_cells), "cells")
    folder = shared_path(spark, "trees")
    queries = placed.where(is_query)
    asked = queries.count()
    block = max(1, min(query_block, max(least_block, -(-asked // nb_partitions(spark)))))

    def tree(key, batch):
        dim, number = key[0].as_py(), key[1].as_py()
        ids = batch.column("vec_id").to_numpy()
        vectors = _matrix(batch.column("vector"), len(ids))
        built = build_tree(ids, vectors, leaf) | {"largest": int(np.abs(vectors).max())}
        file = put_file(folder, f"tree-{dim}-{number:08d}", pickle.dumps(built, protocol=5))
        line = {"dim": [dim], "tree": [{"file": file, "least": int(ids.min()), "low": built["low"][0].tolist(), "high": built["high"][0].tolist()}]}
        return pa.table(line, schema=pa.schema([("dim", pa.int32()), ("tree", pa.struct([("file", pa.string()), ("least", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))]))]))

    def gather(key, batch):
        dim, number = key[0].as_py(), key[1].as_py()
        ids = batch.column("vec_id").to_numpy()
        file = put_file(folder, f"block-{dim}-{number:08d}", pickle.dumps((ids, _matrix(batch.column("vector"), len(ids))), protocol=5))
        return pa.table({"dim": [dim], "block": [file]}, schema=pa.schema([("dim", pa.int32()), ("block", pa.string())]))

    line = "dim int, tree struct<file:string,least:bigint,low:array<bigint>,high:array<bigint>>"
    trees = written(_dealt(placed, shard, "shard", 0).groupBy("dim", "shard").applyInArrow(tree, line), "trees")
    blocks = written(_dealt(queries, block, "number", 1).groupBy("dim", "number").applyInArrow(gather, "dim int, block string"), "blocks")
    # where blocks are too few to employ all tasks, each goes through several shorter lists of trees
    n_trees, n_blocks = trees.count(), blocks.count()
    runs = max(1, -(-n_trees // RUN_TREES), min(n_trees, nb_partitions(spark) // max(1, n_blocks)))

    def boxes(key, batch):
        dim, run = key[0].as_py(), key[1].as_py()
        listed = [r["tree"] for r in batch.to_pylist()]
        box = {"files": [t["file"] for t in listed], "least": [t["least"] for t in listed], "low": np.array([t["low"] for t in listed], np.float64), "high": np.array([t["high"] for t in listed], np.float64)}
        file = put_file(folder, f"boxes-{dim}-{run:08d}", pickle.dumps(box, protocol=5))
        return pa.table({"dim": [dim], "boxes": [file]}, schema=pa.schema([("dim", pa.int32()), ("boxes", pa.string())]))

    lists = trees.withColumn("run", F.pmod(F.xxhash64("tree.file"), F.lit(runs)).cast("int"))
    files = written(lists.groupBy("dim", "run").applyInArrow(boxes, "dim int, boxes string"), "boxes")
    # one line for each block and box file of its length: the query set against all rows, in blocks
    work = blocks.join(F.broadcast(files) if files.count() <= BROADCAST_FILES else files, "dim").select("block", "boxes")

    def search(batches):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for block, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best = _searched(block, pickle.loads(get_file(file)), k)
                ok = best.found != NO_ID
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, ok.sum(axis=1))), pa.array(best.found[ok]), pa.array(best.scores[ok].astype(np.int64))], schema=schema)

    found = work.repartition(nb_partitions(spark), "block", "boxes").mapInArrow(search, "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(block: str, boxes: dict, k: int) -> Best:
    """A block of queries through the trees of a box file, the best root bound first; trees that cannot better any query
    stay closed."""
    ids, raw = pickle.loads(get_file(block))
    largest_query = int(np.abs(raw).max())
    best = Best(ids, _typed(raw, largest_query), k)
    low, high = boxes["low"], boxes["high"]
    positive, negative = np.maximum(raw, 0).astype(np.float64), np.minimum(raw, 0).astype(np.float64)
    order = [float((positive @ h + negative @ w).max()) for h, w in zip(high, low)]
    for i in np.argsort(-np.array(order), kind="stable"):
        if best.queries.dtype.kind == "f":
            bound = positive @ high[i] + negative @ low[i]
            # a bound that is not exact in doubles decides nothing
            if max(np.abs(bound).max(), 0) < 2**52 and not best.may_gain(bound, boxes["least"][i]).any():
                continue
        data = pickle.loads(get_file(boxes["files"][i]))
        largest = max(data["largest"], largest_query)
        if best.queries.dtype.kind == "f" and largest * largest * raw.shape[1] >= 2**53:
            best = _widened(best, raw)
        kind = best.queries.dtype
        best.walk(data | {n: data[n].astype(kind) for n in ("vectors", "low", "high")})
    return best


def _widened(best: Best, raw: np.ndarray) -> Best:
    """The same state in 64-bit integers, for components too large for exact doubles."""
    wide = Best(best.ids, raw.astype(np.int64), best.k)
    ok = best.found != NO_ID
    wide.scores[ok], wide.found = best.scores[ok].astype(np.int64), best.found
    return wide
