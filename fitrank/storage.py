"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below the one that driver and executors share (spark.checkpoint.dir). It is deleted
    when the driver's JVM ends. Where the session names none, a local session gets a temp folder, as in tests; on a
    cluster that is an error, because each machine would write to a disk of its own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fitrank-"))
        root = context.getCheckpointDir()
    own = f"{root.rstrip('/')}/fitrank-{context.applicationId}"
    if own not in _known_roots:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _known_roots.add(own)
    return own


_known_roots: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete what the operators have written so far; frames that read it are of no more use."""
    own = shared_root(spark)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _known_roots.discard(own)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives
    the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files whose numbers are broadcast, some 20 MB; those of more are a table that rows are joined to.
BROADCAST_FILES = 100_000


def row_keys(rows: DataFrame, name: str) -> DataFrame:
    """Adds `name`: a whole number of each row that is the same wherever and however often the row is read. Rows that come
    straight from files are known by file and place; any others are numbered and written first."""
    plan = rows._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    file, place, number = (free_name(rows, n) for n in ("file_of", "place_in", "file_number"))
    if plan.getClass().getSimpleName() == "LogicalRelation":
        try:
            placed = rows.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
        except AnalysisException:
            placed = None
        if placed is not None:
            paths = placed.select(file).distinct()
            few = sorted(r[file] for r in paths.limit(BROADCAST_FILES + 1).collect())
            if len(few) <= BROADCAST_FILES:
                files = F.broadcast(rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(few)], f"`{file}` string, `{number}` long"))
            else:
                files = written(row_numbers(paths, [F.col(file)], number), "files")
            key = F.shiftleft(F.col(number), 40).bitwiseOR(F.col(place))
            return placed.join(files, file).select(*[F.col(f"`{c}`") for c in rows.columns], key.alias(name))
    return written(rows.withColumn(name, F.monotonically_increasing_id()), "rows", "zstd")


#: Bits of a row's place within its partition, as monotonically_increasing_id() counts.
_PLACE = (1 << 33) - 1


def in_order(rows: DataFrame, order: Sequence[Column], part: str, place: str) -> tuple[DataFrame, DataFrame]:
    """rows range-partitioned and sorted, with the number of their partition and their place from 0 in the order of all
    rows; and the partitions that have rows: part, rows, start (the place of the first). What is written carries the place
    within the partition, so nothing is shuffled again. Ties come in any order."""
    local = free_name(rows, "local")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    ranged = written(sorted_rows, "ranged")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    start, of = free_name(ranged, "start"), free_name(ranged, "of")
    starts = F.broadcast(parts.select(F.col("part").alias(of), F.col("start").alias(start)))  # a row a partition
    placed = ranged.join(starts, F.col(part) == F.col(of)).withColumn(place, F.col(start) + F.col(local))
    return placed.drop(start, of, local), parts


def row_numbers(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the place from 0 in an order of all rows, by range partitions and the counts before them; ties in any
    order. Nothing but one count a partition meets in one task."""
    part = free_name(rows, "part")
    return in_order(rows, order, part, name)[0].drop(part)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of df has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a local path, a file: URI or any store pyarrow knows, for tasks that handle files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
