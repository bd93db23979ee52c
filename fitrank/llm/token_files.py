"""Token-id files as directly addressable codes.

Ids are split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, a
continuation bitmap (does the id go on at level k+1?) and a rank directory (ones before each block of 512
bits). The place of an id at level k+1 is the rank of its continuation bit, so any single id is found
without decoding others, and a run of ids is a run at every level.

File: `DAC1`, then unsigned little-endian: levels u32, docs u64, tokens u64, documents without id (they come first)
u64; doc_ids i64[docs];
starts u64[docs + 1]; for each level n u64, chunks u8[n], bitmap u8[ceil(n/8)], directory u64[n//512 + 1];
last crc32 u32 of all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenization as T
from .shared import get_file, nb_partitions, put_file, shared_path, small_batches, written

BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dac_bytes(doc_ids, starts, ids: np.ndarray) -> bytes:
    """One file of documents: starts has one entry more than doc_ids, of which the first may be None; ids are unsigned
    32-bit."""
    nulls = sum(d is None for d in doc_ids)
    if any(d is None for d in doc_ids[nulls:]):
        raise ValueError("documents without id come first")
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ends = np.add.reduceat(np.pad(_ones_of(bits), (0, (-len(bits)) % 64)).astype(np.uint64), np.arange(0, max(len(bits), 1), 64)) if len(bits) else np.zeros(0, np.uint64)
        directory = np.concatenate([[0], np.cumsum(ends)]).astype("<u8")[: len(rest) // BLOCK + 1]
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    body = b"DAC1" + struct.pack("<IQQQ", len(levels), len(doc_ids), len(ids), nulls) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(starts, "<u8").tobytes() + b"".join(levels)
    return body + struct.pack("<I", zlib.crc32(body))


def _ones_of(bits: np.ndarray) -> np.ndarray:
    return _ONES[bits]


class DacFile:
    """Random access to a file's ids."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1" or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token file")
        n_levels, n_docs, self.n_tokens, self.nulls = struct.unpack_from("<IQQQ", data, 4)
        at = 32
        take = lambda dtype, n: np.frombuffer(data, dtype, n, at)
        self.doc_ids, at = take("<i8", n_docs), at + 8 * n_docs
        self.starts, at = take("<u8", n_docs + 1).astype(np.int64), at + 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks, at = take(np.uint8, n), at + n
            bits, at = take(np.uint8, -(-n // 8)), at + -(-n // 8)
            directory, at = take("<u8", n // BLOCK + 1), at + 8 * (n // BLOCK + 1)
            self.levels.append((chunks, bits, directory))

    def rank(self, level: int, i: int) -> int:
        """Continuation bits set before place i."""
        _, bits, directory = self.levels[level]
        block = i // BLOCK
        ones = int(directory[block]) + int(_ONES[bits[block * 64 : i // 8]].sum())
        return ones + (int(_ONES[bits[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def get(self, i: int) -> int:
        """The i-th id, from one chunk a level."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self.rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1: a run at each level."""
        return self._run(0, a, b)

    def _run(self, level: int, a: int, b: int) -> np.ndarray:
        chunks, bits, _ = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        n = int(more.sum())
        if n:
            first = self.rank(level, a)
            out[more] |= self._run(level + 1, first, first + n) << np.uint32(8)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, tokens_a_file: int = 4_000_000) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, and write files in ascending doc_id order
    (null ids first). Files are named by place in that order, so a repeated task writes the same file
    again. Returns the manifest: part, seq, file, n_docs, n_tokens."""
    small_batches(docs.sparkSession)
    end = np.uint32(end_id).tobytes()

    def write(batches):
        encode, part, seq = T.coder(path).encode, TaskContext.get().partitionId(), 0
        doc_ids: list = []
        texts: list = []
        size = 0
        rows: list = []

        def flush():
            nonlocal doc_ids, texts, size, seq
            ids = np.frombuffer(b"".join(texts), np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in texts])]).astype(np.int64)
            file = put_file(folder, f"part-{part:06d}-{seq:06d}.dac", dac_bytes(doc_ids, starts, ids))
            rows.append((part, seq, file, len(doc_ids), len(ids)))
            doc_ids, texts, size, seq = [], [], 0, seq + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                texts.append((encode(text) if text else b"") + end)
                size += len(texts[-1]) // 4
                if size >= tokens_a_file:
                    flush()
        if doc_ids:
            flush()
        yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, r)) for r in rows], schema=_MANIFEST)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(nb_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "part long, seq long, file string, n_docs long, n_tokens long"), "manifest")


_MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids before it over all files), n_tokens,
    ids_crc32. A file that isn't whole raises."""

    def read(batches):
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                dac = DacFile(get_file(file))
                starts = dac.starts
                data = memoryview(dac.slice(0, dac.n_tokens).astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                ids = pa.array(dac.doc_ids, pa.int64(), mask=np.arange(len(dac.doc_ids)) < dac.nulls)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one task, but one row a file
    upto = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)))
    spread = placed.select("file", "before").repartition(nb_partitions(manifest.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back.

    Null texts are empty (the end id alone); repeated rows are repeated documents; other columns are
    ignored; an empty table writes no file and gives no rows."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, folder, **options))
