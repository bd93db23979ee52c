"""MinHash near-duplicates with odd sketches.

Texts of one shingle set are one class; only its smallest document goes on. Bands of MinHash samples put
similar classes into common buckets (at the threshold all bands miss a pair with probability below 1e-6).
The samples are also folded into a parity bitmap: the XOR of two bitmaps has a bit for each sample that
differs, so its population count estimates high similarities closely. Candidates whose estimate lies
`slack` standard deviations below the threshold are left out. A second, larger bitmap holds the parity of whole
sets: its XOR never has more bits than the sets have differing shingles, so it leaves out pairs just below the
threshold without losing any. What remains is confirmed on full sets.

First each member meets its bucket's smallest one, which settles groups of copies in linear time. Components
follow. Then, in buckets that still hold several components, members outside the largest one meet the members of
other components whose size is in reach, bitmaps first: the join's key is the bucket and a class of sizes, which loses
nothing. Buckets of copies thus cost what they hold; a bucket of many texts of one size that are related but no copies
(half of their shingles from one template) is compared by pairs, which no cap cuts short: its cost grows with the square
of its components. Hot buckets meet in joins that Spark splits.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import giving_back, small_batches, written

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SKETCH_WORDS = 8
#: Words of the whole-set bitmap: 2048 bits tell some 100 differing shingles almost exactly.
PARITY_WORDS = 32
#: Ids that may be broadcast: 1 million are some 30 MB.
BROADCAST_IDS = 1_000_000
#: Words whose hash a worker remembers: some 40 MB; workers live on beside the stages that follow.
REMEMBERED_WORDS = 200_000


#: Bytes of a batch of texts; both a worker and its JVM hold some of them.
BATCH_BYTES = 4 << 20


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _forgetting(batches):
    """A stage's batches; its worker remembers no words beyond its end."""
    try:
        yield from giving_back(batches)
    finally:
        _words.clear()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K1
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. Words are runs of anything but ASCII white space,
    A-Z lower-cased; fewer words than `width` are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        h = _mix(np.array([len(words)], np.uint64))
        for i in range(len(ids)):
            h = _mix(h * _K1 + ids[i : i + 1])
        return h
    n = len(ids) - width + 1
    h = ids[:n]
    for j in range(1, width):
        h = _mix(h * _K1 + ids[j : j + n])
    return np.unique(h)


class Signer:
    """MinHash samples, bands and odd sketches of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.a = rng.integers(0, 2**32, self.k, np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, self.k, np.uint64).astype(np.uint32)
        self.salt = _mix(np.arange(1, self.k + 1, dtype=np.uint64) * _K1)

    def samples(self, sets: list[np.ndarray]) -> np.ndarray:
        """(documents, k) minima; the sets are not empty."""
        out = np.empty((self.k, len(sets)), np.uint32)
        at = 0
        while at < len(sets):
            end, n = at, 0
            while end < len(sets) and (end == at or n + len(sets[end]) <= 100_000):
                n += len(sets[end])
                end += 1
            x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
            h = np.empty_like(x)
            for i in range(self.k):
                np.multiply(x, self.a[i], out=h)
                np.bitwise_xor(h, self.b[i], out=h)
                out[i, at:end] = np.minimum.reduceat(h, starts)
            at = end
        return out.T

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """(documents, bands) bucket keys; equal ones of different bands don't meet."""
        h = np.broadcast_to(_mix(np.arange(1, self.bands + 1, dtype=np.uint64) * _K2), (len(samples), self.bands)).copy()
        parts = samples.reshape(len(samples), self.bands, self.rows).astype(np.uint64)
        for j in range(self.rows):
            h = _mix(h * _K1 + parts[:, :, j])
        return h.view(np.int64)

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """(documents, SKETCH_WORDS) parity bitmaps of all (place, sample) pairs."""
        bit = _mix(samples.astype(np.uint64) * _K1 + self.salt) % np.uint64(64 * SKETCH_WORDS)
        flat = np.arange(len(samples))[:, None] * 64 * SKETCH_WORDS + bit.astype(np.int64)
        odd = (np.bincount(flat.ravel(), minlength=len(samples) * 64 * SKETCH_WORDS) & 1).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(samples), SKETCH_WORDS)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, PARITY_WORDS) parity bitmaps of whole sets."""
    bits = 64 * PARITY_WORDS
    if not sets:
        return np.zeros((0, PARITY_WORDS), np.int64)
    x = np.concatenate(sets) >> np.uint64(64 - bits.bit_length() + 1)
    flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * bits + x.astype(np.int64)
    odd = (np.bincount(flat, minlength=len(sets) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(sets), PARITY_WORDS)


def widest_xor(threshold: float, k: int, slack: float) -> int:
    """XOR bits that a pair at the threshold stays within, `slack` standard deviations out."""
    n, differ = 64 * SKETCH_WORDS, 2 * k * (1 - threshold)
    p = (1 - np.exp(-2 * differ / n)) / 2
    sampled = 2 * np.sqrt(k * threshold * (1 - threshold)) * np.exp(-2 * differ / n)
    return int(np.ceil(n * p + slack * np.sqrt(n * p * (1 - p) + sampled**2)))


def _signed(docs: DataFrame, width: int, signer: Signer, keep: list[str]) -> DataFrame:
    names = ["row", "doc_id", "n_shingles", "class", "keys", "sketch", "parity", *keep]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]

    def sign(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 500):
                sets = [shingle_set(t, width) for t in texts[at : at + 500]]
                full = [s for s in sets if len(s)]
                has = np.array([len(s) > 0 for s in sets])
                samples = signer.samples(full)
                arrays = signer.keys(samples), signer.sketches(samples), parities(full)
                where = np.where(has, np.cumsum(has) - 1, -1).tolist()
                digest = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                columns = [range(row + 1, row + 1 + len(sets)), ids[at : at + 500], [len(s) for s in sets], digest, *([a[i] if i >= 0 else None for i in where] for a in arrays)]
                row += len(sets)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), *(c.slice(at, 500) for c in batch.columns[2:])], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(k).cast("long").alias(k) for k in keep])
    return rows.mapInArrow(lambda batches: _forgetting(sign(batches)), "row long, doc_id long, n_shingles long, class binary, keys array<long>, sketch array<long>, parity array<long>" + "".join(f", {k} long" for k in keep))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_set(t, width).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").mapInArrow(lambda batches: _forgetting(sets(batches)), "node long, shingles array<long>")


def _sketch_bits(a: str, b: str):
    """XOR bits of two sketches, unrolled: it is asked of every pair that meets."""
    bits = F.lit(0)
    for i in range(SKETCH_WORDS):
        bits = bits + F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i]))
    return bits


def _parity_bits(a: str, b: str):
    """XOR bits of two whole-set bitmaps, asked of pairs whose sketches are close."""
    bits = F.zip_with(f"{a}.parity", f"{b}.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda n, x: n + x)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, slack: float = 6.0, key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents with 100 * common >= percent * united shingles are linked;
    a component is named by its smallest doc_id, the one that is kept.

    Null, empty and blank texts have no shingles and no links. Rows of one doc_id are one document (repeated rows
    give repeated results); a row without doc_id is linked with nothing, component_id is null and it is kept.
    `key` names a whole-number column that tells rows apart and is returned too (default doc_id).
    Other columns are ignored; an empty table gives no rows."""
    small_batches(docs.sparkSession, rows=1000, size=BATCH_BYTES)
    keep = [key] if key != "doc_id" else []
    signer = Signer(bands, rows)
    widest = widest_xor(percent / 100, signer.k, slack)
    signed = written(_signed(docs, width, signer, keep), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(usable.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("class", F.col("first.doc_id").alias("node"), F.col("first.row").alias("row")), "classes")
    firsts = written(usable.join(classes.select("row", "node"), "row").select("node", "n_shingles", "keys", "sketch", "parity"), "firsts")
    members = firsts.select("node", F.explode("keys").alias("bucket"))
    marks = firsts.select("node", "n_shingles", "sketch", "parity")

    def alike(a, b):
        small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
        most = (small + large) * (100 - percent)  # a pair at the threshold has so many hundred-and-percent-ths of differing shingles
        return (small * 100 >= large * percent) & (_sketch_bits(a, b) <= widest) & (_parity_bits(a, b) * (100 + percent) <= most)

    # 1: members meet their bucket's smallest
    common = members.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(members.join(common, "bucket"), "shared")
    star = shared.where("a < node").select("a", F.col("node").alias("b")).distinct()
    near = star.join(marks.alias("x"), F.col("a") == F.col("x.node")).join(marks.alias("y"), F.col("b") == F.col("y.node")).where(alike("x", "y")).select("a", "b")
    tried = written(near, "pairs")
    links = written(_confirmed(docs, tried, width, percent), "confirmed")
    labels = connected_components(links)

    # 2: in buckets of several components, those outside the largest meet the others
    named = shared.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    counted = named.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max(F.struct("count", (-F.col("component")).alias("component"))).alias("most"), F.count("*").alias("n"))
    mixed = counted.where("n > 1").select("bucket", (-F.col("most.component")).alias("home"))
    open_members = written(named.join(mixed, "bucket").join(marks, "node"), "open")
    # sizes of a pair at the threshold lie within a ratio of 100 / percent, so their classes differ by one at most
    size_class = F.floor(F.log("n_shingles") / (math.log(max(100 / percent, 1.0001)) * (1 + 1e-9)))
    x = open_members.where("component <> home").withColumn("meets", size_class).alias("x")
    y = open_members.withColumn("meets", F.explode(F.array(size_class - 1, size_class, size_class + 1))).alias("y")
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.meets") == F.col("y.meets")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.home")) | (F.col("x.node") < F.col("y.node")))
    late = x.join(y, meet & alike("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    late = written(late.join(tried, ["a", "b"], "left_anti"), "late")
    if not late.isEmpty():
        more = written(_confirmed(docs, late, width, percent), "confirmed")
        if not more.isEmpty():
            labels = connected_components(links.union(more))

    grouped = classes.select("class", "node").join(labels, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    # a null class joins nothing, so documents without shingles are their own component
    return signed.join(grouped, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.col("doc_id").isNull() | (F.coalesce("component", "doc_id") == F.col("doc_id"))).alias("kept"), *keep)


def _confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = written(nodes, "nodes")
    # a checked size: beyond it the texts are shuffled to their ids
    side = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    sets = written(_sets(docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("node"), "left_semi"), width), "sets")
    x, y = sets.alias("x"), sets.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    inter = F.size(F.array_intersect("x.shingles", "y.shingles"))
    return both.select("a", "b", inter.alias("i"), (F.size("x.shingles") + F.size("y.shingles")).alias("n")).where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b").distinct()
