"""Interpolated modified Kneser-Ney language models, counted in Spark and kept as sorted hash arrays.

Words are counted first and numbered by frequency. Texts then become n-grams of word numbers; each task counts its own
chunk by chunk and deals them, compressed, to buckets by ranges of their hash. A bucket adds up its counts, writes its
n-grams as a file of sorted hashes with their counts, and hands on what the next lower order needs: each distinct n-gram
is one continuation of its last words (one that starts a text keeps its count), and adds to the total and to the numbers
of singles, doubles and more of its first words as a context. So one job with a shuffle an order counts the whole model.
Discounts come from the numbers of n-grams seen once to four times.

Workers map the files into memory and look hashes up by the sorted chunk, bucket after bucket; where the shared folder is
no mounted file system, they read the files. Files of up to `bucket` n-grams keep tasks small at any size.
"""

from __future__ import annotations

import os
import struct
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, get_file, nb_partitions, put_file, row_numbers, shared_path, small_batches, written

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Numbers that no word has: nothing before a text's begin, the begin; words follow.
NOTHING, BEGIN, FIRST_WORD = 0, 1, 2
#: Tokens that a worker looks up at a time.
CHUNK_TOKENS = 500_000
#: Files that a worker keeps open, and bytes of those that cannot be mapped.
OPEN_FILES, HELD_BYTES = 2048, 64 << 20
#: An n-gram's counts: its own, then as a context: total, followers seen once, twice, more often.
OWN, TOTAL, ONCE, TWICE, MORE = range(5)


#: A word's hash is the sum of its bytes' values times powers of an odd number: whole buffers at once, no objects. The
#: values are random numbers; A-Z have those of a-z.
_POWER = 0x9E3779B97F4A7C17
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The end of a text; no word holds white space.
END = np.uint64(0xE17A1465D4C3A2B1)
#: Bytes that are hashed at a time, up to the next white space.
PIECE_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_forward = _backward = np.ones(1, np.uint64)


def _hash_piece(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece; a word ends at white space and at cuts, the starts of texts."""
    global _forward, _backward
    if len(data) > len(_forward):
        _forward, _backward = _powers(_POWER, len(data)), _powers(pow(_POWER, -1, 2**64), len(data))
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    terms = _VALUES[data]
    terms *= _forward[: len(data)]
    terms[~inside] = 0
    h = np.add.reduceat(terms, starts) * _backward[starts]
    return _mix(h), starts


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, A-Z lower-cased, each text followed by END; and each text's number of both. A
    null text is empty. Texts are read from their UTF-8 buffer, in pieces that end at white space."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    # what a null text's slot holds, if anything, is no text of it
    lengths = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)) if texts.null_count else np.diff(offsets)
    begin = (offsets[:-1] - offsets[0]).astype(np.int64)
    if (begin + lengths != np.append(begin[1:], len(data))).any():
        data = np.concatenate([data[a : a + n] for a, n in zip(begin, lengths)])
        begin = np.cumsum(lengths) - lengths
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            space = np.flatnonzero(_SPACE[data[end : end + PIECE_BYTES]])
            end = end + int(space[0]) if len(space) else min(end + PIECE_BYTES, len(data))
        cuts = begin[np.searchsorted(begin, at) : np.searchsorted(begin, end)]
        h, s = _hash_piece(data[at:end], cuts - at)
        hashes.append(h)
        starts.append(s + at)
        at = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    of = np.searchsorted(begin, np.concatenate(starts), "right") - 1 if starts else np.zeros(0, np.int64)
    n = np.bincount(of, minlength=len(texts)) + 1 if len(texts) else np.zeros(0, np.int64)
    out = np.full(len(words) + len(texts), END, np.uint64)
    out[np.arange(len(words)) + of] = words
    return out, n


def text_groups(texts: pa.Array, size: int = PIECE_BYTES):
    """(first, number) of runs of texts of about `size` bytes together, one text at least."""
    sizes = np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + size, "right")) - 1)
        yield at, end - at
        at = end


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K1
    return h ^ (h >> np.uint64(31))


def longer(h: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    """The hash of n-grams with one more word; from none, of single words."""
    start = np.uint64(0x243F6A8885A308D3) if h is None else h * _K1
    return _mix(start + word.astype(np.uint64))


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as (n, count)."""
    h = None
    for word in grams:
        h = longer(h, word)
    return h


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, from 0 up."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def pack(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """(n, count) n-grams and (columns, count) counts, compressed; the first words rise."""
    rows = [np.diff(grams[0], prepend=grams.dtype.type(0)), *grams[1:]]
    narrow = _narrow(counts)
    planes = b"".join(r.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for r in rows)
    head = struct.pack("<BBBI", len(grams), len(counts), narrow.itemsize, grams.shape[1])
    return head + zstandard.ZstdCompressor(1).compress(planes + narrow.tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    order, columns, width, n = struct.unpack_from("<BBBI", data)
    raw = zstandard.ZstdDecompressor().decompress(data[7:])
    planes = np.frombuffer(raw, np.uint8, 4 * order * n).reshape(order, 4, n)
    grams = np.array(planes.transpose(0, 2, 1), order="C").view("<u4")[:, :, 0]
    grams[0] = np.cumsum(grams[0], dtype=np.uint32)
    return grams, np.frombuffer(raw, f"<u{width}", columns * n, 4 * order * n).reshape(columns, n).astype(np.uint64)


def merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, their n-grams and summed counts."""
    h = gram_hash(grams)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[:, order], first, axis=1) if len(h) else counts
    return h[first], grams[:, order[first]], sums


class Sums:
    """Adds up packed n-grams of one bucket; equal ones are merged whenever many have come."""

    def __init__(self, order: int, columns: int):
        self.columns, self.new, self.parts = columns, 0, [(np.zeros((order, 0), np.uint32), np.zeros((columns, 0), np.uint64))]

    def add(self, data: bytes) -> None:
        grams, counts = unpack(data)
        self.parts.append((grams, np.vstack([counts, np.zeros((self.columns - len(counts), counts.shape[1]), np.uint64)])))
        self.new += grams.shape[1]
        if self.new >= CHUNK_TOKENS:
            _, grams, counts = self.merged()
            self.parts, self.new = [(grams, counts)], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return merged(np.hstack([g for g, _ in self.parts]), np.hstack([c for _, c in self.parts]))


def _dealt(grams: np.ndarray, counts: np.ndarray, h: np.ndarray, buckets: int):
    """(bucket, packed n-grams) of each bucket that has any."""
    of = bucket_of(h, buckets)
    order = np.argsort((of.astype(np.uint64) << np.uint64(32)) | grams[0].astype(np.uint64))
    of, grams, counts = of[order], grams[:, order], counts[:, order]
    cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(of[a]), pack(grams[:, a:b], counts[:, a:b])


def stream(numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts one after the other, each after a BEGIN, and each one's place in its text."""
    starts = np.cumsum(lengths + 1) - lengths - 1
    words = np.full(len(numbers) + len(lengths), BEGIN, np.uint32)
    of = np.repeat(np.arange(len(lengths)), lengths)
    words[np.arange(len(numbers)) + of + 1] = numbers
    return words, np.arange(len(words)) - np.repeat(starts, lengths + 1)


def text_grams(words: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """(order, count): the n-gram that ends at each word but BEGIN; NOTHING stands before BEGIN."""
    rows = []
    for back in range(order - 1, -1, -1):
        row = np.full(len(words), NOTHING, np.uint32)
        row[back:] = words[: len(words) - back]
        row[place < back] = NOTHING
        rows.append(row[place > 0])
    return np.array(rows)


# --- files -------------------------------------------------------------------------------------------------------------


def file_bytes(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes, then for each the place of its counts in the table of distinct counts that follows."""
    key = gram_hash(counts)
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    of, table = _narrow(of), counts[:, first].astype("<u8")
    return struct.pack("<QQBB", len(h), table.shape[1], len(counts), of.itemsize) + bytes(6) + h.astype("<u8").tobytes() + table.tobytes() + of.tobytes()


class Shard:
    """One file of sorted hashes, mapped where it can be."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        local = store.type_name == "local"
        if not (os.path.exists(path) if local else store.get_file_info(path).is_file):
            self.hashes, self.held = np.zeros(0, np.uint64), 0
            return
        data = np.memmap(path, np.uint8, "r") if local else np.frombuffer(get_file(uri), np.uint8)
        self.held = 0 if local else len(data)
        n, distinct, columns, width = struct.unpack_from("<QQBB", data[:18].tobytes())
        self.hashes = data[24 : 24 + 8 * n].view("<u8")
        at = 24 + 8 * n
        self.table = data[at : at + 8 * columns * distinct].view("<u8").reshape(columns, distinct)
        self.of = data[at + 8 * columns * distinct :][: n * width].view(f"<u{width}")

    def find(self, h: np.ndarray, out: np.ndarray) -> None:
        """Counts of hashes into out, (columns, count); those that are not here stay 0."""
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            there = np.flatnonzero(self.hashes[at] == h)
            out[:, there] = self.table[:, self.of[at[there]]]


class Shards:
    """Files of one level, opened when first asked for; the least recently used are closed."""

    def __init__(self):
        self.open: OrderedDict[str, Shard] = OrderedDict()
        self.held = 0

    def shard(self, name: str) -> Shard:
        found = self.open.pop(name, None)
        if found is None:
            found = Shard(name)
            self.held += found.held
        self.open[name] = found
        while len(self.open) > OPEN_FILES or (self.held > HELD_BYTES and len(self.open) > 1):
            self.held -= self.open.popitem(last=False)[1].held
        return found

    def counts(self, folder: str, level: str, buckets: int, h: np.ndarray, columns: int) -> np.ndarray:
        """(columns, count) of hashes in any order."""
        distinct, back = np.unique(h, return_inverse=True)
        out = np.zeros((columns, len(distinct)), np.int64)
        cuts = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1)) if len(distinct) >= buckets else None
        present = np.unique(bucket_of(distinct, buckets)) if cuts is None else np.flatnonzero(np.diff(cuts))
        for b in present:
            a, z = (cuts[b], cuts[b + 1]) if cuts is not None else np.searchsorted(bucket_of(distinct, buckets), [b, b + 1])
            self.shard(f"{folder}/{level}-{b:08d}").find(distinct[a:z], out[:, a:z])
        return out[:, back]


_shards = Shards()


# --- model -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """What workers need besides the files: a few numbers."""

    folder: str
    order: int
    tokens: int
    words: int
    word_buckets: int
    buckets: tuple[int, ...]  # by order, from 1
    discounts: tuple[tuple[float, float, float, float], ...]  # by order, from 1: of counts 0, 1, 2, more
    total: int  # of the counts of single words
    left: float  # what their discounts leave, of that total

    def lookup_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of words; unknown ones have the number after the last, and 0."""
        number, n = _shards.counts(self.folder, "words", self.word_buckets, h, 2)
        return np.where(n > 0, number, FIRST_WORD + self.words).astype(np.uint32), n

    def log10(self, words: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of each word of a stream after those before it in its text; 0 at BEGIN."""
        h, context, p = None, None, np.full(len(words), self.left / max(1, self.total) / (self.words + 1)) if self.total else np.full(len(words), 1 / (self.words + 1))
        for k in range(1, self.order + 1):
            h = longer(None, words) if k == 1 else np.append(np.uint64(0), longer(h[:-1], words[1:]))
            there = np.flatnonzero(place >= k - 1)
            counts = np.zeros((5 if k < self.order else 1, len(words)), np.int64)
            counts[:, there] = _shards.counts(self.folder, f"order{k}", self.buckets[k - 1], h[there], len(counts))
            own, cut = counts[OWN], np.array(self.discounts[k - 1])
            kept = own - cut[np.minimum(own, 3)]
            if k == 1:
                p = p + kept / self.total if self.total else p
            else:
                total = np.append(0, context[TOTAL, :-1])
                left = np.append(0.0, cut[1:] @ context[ONCE:, :-1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where((total > 0) & (place >= k - 1), (kept + left * p) / total, p)
            context = counts
        return np.where(place > 0, np.log10(p), 0.0)


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """Of counts 0, 1, 2 and more, from the numbers of n-grams seen once to four times; a half, one and one and a half
    where these say nothing."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3, n4) == 0:
        return (0.0, 0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return (0.0, *(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), found)))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n of all texts and their ends."""

    def count(batches):
        held, n_held = [], 0

        def handed_on():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            held.append(tokens(batch.column(0))[0])
            n_held += len(held[-1])
            if n_held >= 4 * CHUNK_TOKENS:
                yield handed_on()
                n_held = 0
        if held:
            yield handed_on()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


_ROWS = "level int, bucket int, grams binary, stats array<long>"
_SCHEMA = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _rows(level: int, buckets, grams, stats=None) -> pa.RecordBatch:
    n = len(buckets)
    return pa.RecordBatch.from_arrays([pa.array([level] * n, pa.int32()), pa.array(buckets, pa.int32()), pa.array(grams, pa.binary()), pa.array(stats or [None] * n, pa.list_(pa.int64()))], schema=_SCHEMA)


def _words_files(numbered: DataFrame, folder: str, buckets: int) -> DataFrame:
    """One row a file of words: hash -> number, training count."""

    def put(key, batch):
        h = batch.column("word").to_numpy().view(np.uint64)
        order = np.argsort(h)
        counts = np.array([batch.column("number").to_numpy()[order] + FIRST_WORD, batch.column("n").to_numpy()[order]], np.uint64)
        put_file(folder, f"words-{key[0].as_py():08d}", file_bytes(h[order], counts))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([len(h)], pa.int64())})

    bucket = F.floor(F.shiftrightunsigned("word", 32) * buckets / 2.0**32).cast("int")
    return numbered.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(put, "bucket int, words long")


def _text_counts(docs: DataFrame, model: Model) -> DataFrame:
    """N-grams of the highest order with their counts, by task and chunk, dealt to buckets."""
    order, buckets = model.order, model.buckets[-1]

    def count(batches):
        held, n_held = [], 0

        def handed_on():
            hashes, lengths = (np.concatenate(x) for x in zip(*held))
            numbers, _ = model.lookup_words(hashes)
            grams = text_grams(*stream(numbers, lengths), order)
            h, grams, counts = merged(grams, np.ones((1, grams.shape[1]), np.uint64))
            held.clear()
            dealt = list(_dealt(grams, counts, h, buckets))
            return _rows(order, [b for b, _ in dealt], [g for _, g in dealt])

        for batch in batches:
            for first, number in text_groups(batch.column(0)):
                held.append(tokens(batch.column(0).slice(first, number)))
                n_held += len(held[-1][0])
                if n_held >= 2 * CHUNK_TOKENS:
                    yield handed_on()
                    n_held = 0
        if held:
            yield handed_on()

    return docs.select("text").mapInArrow(count, _ROWS)


def _level(rows: DataFrame, model: Model, k: int) -> DataFrame:
    """Adds up the n-grams of order k by bucket, writes their files and hands on those of order k - 1; rows of stats
    (n-grams seen once to four times, their number and total) pass through."""
    folder, buckets, lower = model.folder, model.buckets[k - 1], model.buckets[k - 2] if k > 1 else 0
    columns = 1 if k == model.order else 5

    def one(bucket: int, held: Sums):
        h, grams, counts = held.merged()
        begun = grams[0] == NOTHING
        stored = ~begun
        put_file(folder, f"order{k}-{bucket:08d}", file_bytes(h[stored], counts[:, stored]))
        own = counts[OWN]
        real = stored & (own > 0)
        stats = [*np.bincount(np.minimum(own[real], 5).astype(np.int64), minlength=6)[1:5].tolist(), int(real.sum()), int(own[real].sum())]
        yield _rows(k, [bucket], [None], [stats])
        if k > 1:
            last = np.flatnonzero(own > 0)
            low = np.zeros((5, len(last)), np.uint64)
            low[OWN] = np.where(begun[last], own[last], np.uint64(1))
            contexts = np.flatnonzero(real)
            high = np.zeros((5, len(contexts)), np.uint64)
            high[TOTAL] = own[contexts]
            for column, seen in ((ONCE, own[contexts] == 1), (TWICE, own[contexts] == 2), (MORE, own[contexts] > 2)):
                high[column] = seen
            h, grams, counts = merged(np.hstack([grams[1:, last], grams[:-1, contexts]]), np.hstack([low, high]))
            dealt = list(_dealt(grams, counts, h, lower))
            yield _rows(k - 1, [b for b, _ in dealt], [g for _, g in dealt])

    def add_up(batches):
        at, held = None, Sums(k, columns)
        for batch in batches:
            done = batch.filter(pa.compute.not_equal(batch.column(0), k))
            if done.num_rows:
                yield done
            batch = batch.filter(pa.compute.equal(batch.column(0), k))
            for bucket, grams in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != at and at is not None:
                    yield from one(at, held)
                    held = Sums(k, columns)
                at = bucket
                held.add(grams)
        if at is not None:
            yield from one(at, held)

    return rows.repartition(buckets, "bucket").sortWithinPartitions("level", "bucket").mapInArrow(add_up, _ROWS)


def train(docs: DataFrame, order: int = 2, bucket: int = 300_000) -> Model:
    """The model of all texts of docs (null: empty, an end alone). Buckets hold about `bucket` n-grams at most, before
    equal ones are added up; an empty table gives a model that knows nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    counted = written(word_counts(docs), "word_counts", "zstd")
    n_words, n_tokens = (int(x or 0) for x in counted.agg(F.count("*"), F.sum("n")).first())
    if n_words >= 2**32 - 8:
        raise ValueError("more words than 32-bit numbers")
    folder = shared_path(spark, "model")
    parts = max(1, -(-n_tokens // bucket))
    word_buckets = max(1, -(-n_words // bucket))
    model = Model(folder, order, n_tokens, n_words, word_buckets, tuple(parts if k > 1 else max(word_buckets, -(-parts // 4)) for k in range(1, order + 1)), (), 0, 0.0)
    if not n_tokens:
        return Model(**{**model.__dict__, "discounts": ((0.0, 0.5, 1.0, 1.5),) * order})
    _words_files(row_numbers(counted, [F.desc("n"), F.asc("word")], "number"), folder, word_buckets).agg(F.sum("words")).first()
    rows = _text_counts(docs, model)
    for k in range(order, 0, -1):
        rows = _level(rows, model, k)
    sums = rows.groupBy("level").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(6)]).orderBy("level").collect()  # a row an order
    cuts = tuple(discounts([r[f"s{i}"] for i in range(4)]) for r in sums)
    single, cut = sums[0], cuts[0]
    left = cut[1] * single["s0"] + cut[2] * single["s1"] + cut[3] * (single["s4"] - single["s0"] - single["s1"])
    return Model(**{**model.__dict__, "discounts": cuts, "total": int(single["s5"]), "left": float(left)})


def score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each text; long texts go window by window."""
    hashes, lengths = tokens(texts)
    numbers, n = model.lookup_words(hashes)
    first = np.cumsum(lengths) - lengths
    base = np.log10((n + 1) / (model.tokens + model.words + 1))
    words, place = stream(numbers, lengths)
    logs = np.empty(len(words))
    for a in range(0, len(words), CHUNK_TOKENS):
        back = max(0, a - model.order + 1)
        logs[a : a + CHUNK_TOKENS] = model.log10(words[back : a + CHUNK_TOKENS], place[back : a + CHUNK_TOKENS])[a - back :]
    total = np.add.reduceat(logs, first + np.arange(len(first)))
    return lengths, np.add.reduceat((n > 0).astype(np.int64), first), np.add.reduceat(base, first), total


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known (seen in training), base_score (add-one), score (log10 probability of the text) and
    perplexity of every whole text (null: empty). Repeated rows and null ids give a row each; other columns are ignored."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]

    def scored(batches):
        for batch in batches:
            for first, number in text_groups(batch.column(1), 4 * PIECE_BYTES):
                n, known, base, total = score_texts(model, batch.column(1).slice(first, number))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, number), *map(pa.array, (n, known, base, total, 10 ** (-total / n)))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, schema)


def is_held_out() -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id is no text and not held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 7 == 2
