"""Helpers of the training-data operators: tables, files and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fitrank.shipping import ship
from fitrank.storage import filesystem, free_name, release, row_keys, row_numbers, shared_path, shared_root, written

__all__ = ["filesystem", "free_name", "get_file", "giving_back", "nb_partitions", "put_file", "release", "row_keys", "row_numbers", "shared_path", "shared_root", "small_batches", "table", "written"]


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Ready the session for Python stages: workers get this package, and Arrow batches stay small enough
    for long texts, at most `rows` rows and about `size` bytes unless the session asks for fewer."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def giving_back(batches):
    """The batches of a stage; at its end the worker, which lives on beside the stages that follow, gives memory that it no
    longer uses back to the machine."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write under a name of its own, then rename: a lost or repeated task leaves no half file."""
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    temp = f"{base}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as out:
        out.write(data)
    store.move(temp, f"{base}/{name}")
    return f"{folder}/{name}"


def get_file(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return f.read()


def nb_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
