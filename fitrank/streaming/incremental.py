"""Event-time aggregates of data that keeps arriving: windows, sessions and keyed state, each restarted from its checkpoint.

A load appends what has arrived to a folder, runs the query over what is new and ends (trigger availableNow); the next
load starts the same query again from the checkpoint, with its state and its watermark. Results are a log of batches in
the shared folder: a batch that runs twice, because a driver was lost, replaces its own files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship
from ..storage import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Incremental:
    """A streaming query over a folder that grows. build: a frame of arrivals -> the frame that is kept."""

    def __init__(self, spark: SparkSession, schema: T.StructType, build: Callable[[DataFrame], DataFrame], mode: str = "append", name: str = "stream", files_a_batch: int = 1000):
        self.spark, self.schema, self.build, self.mode, self.files = spark, schema, build, mode, files_a_batch
        self.arrivals, self.checkpoint, self.results = (shared_path(spark, f"{name}-{part}") for part in ("arrivals", "checkpoint", "results"))
        self.progress: list[dict] = []

    def load(self, rows: DataFrame) -> None:
        """Appends rows and runs the query over all that is new."""
        rows.select(self.schema.fieldNames()).write.mode("append").parquet(self.arrivals)
        self.run()

    def run(self) -> None:
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.arrivals)
        results = self.results

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{results}/batch={number}")

        query = self.build(stream).writeStream.outputMode(self.mode).foreachBatch(keep).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress += [p for p in query.recentProgress]

    def log(self) -> DataFrame:
        """All that was kept, with `batch`, the number of the batch."""
        schema = self.build(self.spark.readStream.schema(self.schema).parquet(self.arrivals)).schema
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", self.results).parquet(self.results)

    def latest(self, keys: Sequence[str]) -> DataFrame:
        """The last state of each key, where a mode of updates tells it again and again."""
        log = self.log()
        rest = [c for c in log.columns if c not in keys and c != "batch"]
        last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
        return last.select(*keys, "last.*")

    def late_rows(self) -> int:
        """State rows left out because the watermark had passed them."""
        return sum(o["numRowsDroppedByWatermark"] for p in self.progress for o in p["stateOperators"])


def event_windows(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "1 hour", by: Sequence[str] = (), aggregates: Sequence[Column] = ()) -> DataFrame:
    """begun, ended, `by` and aggregates of tumbling windows, or of sliding ones. The same on a table and on a stream; on
    a stream rows may be `late` behind the latest, windows whose end is further behind are closed and their rows left
    out. Rows without a time are in no window."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = timed.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by).agg(*aggregates)
    ends = [F.col(f"window.{end}").cast("timestamp_ntz").alias(name) for end, name in (("start", "begun"), ("end", "ended"))]
    return grouped.select(*ends, *[c for c in grouped.columns if c != "window"])


def event_sessions(events: DataFrame, time: str, gap: str, late: str = "1 hour", by: Sequence[str] = (), aggregates: Sequence[Column] = ()) -> DataFrame:
    """begun, ended (the last row's time), `by` and aggregates of runs of rows with `gap` at most from one to the next;
    as `ordered.with_sessions` finds them in a table. On a stream in append mode a session comes out once the watermark
    has passed its end."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = timed.groupBy(F.session_window(time, gap), *by).agg(F.max(time).alias("last_time"), *aggregates)
    begun, ended = F.col("session_window.start").cast("timestamp_ntz").alias("begun"), F.col("last_time").cast("timestamp_ntz").alias("ended")
    return grouped.select(begun, ended, *[c for c in grouped.columns if c not in ("session_window", "last_time")])


#: Keys are dealt to that many buckets; a bucket's keys share a call of Python, a state and a timer, whose cost of
#: milliseconds would else be paid by every key.
BUCKETS = 1024
RUN = {"key": "long", "begun_us": "long", "ended_us": "long", "rows": "long", "value": "double"}


class Engagement(StatefulProcessor):
    """Engagement of a bucket of keys: of each key, rows and value since it was last idle for `idle_ms`. Each batch tells
    the running sums of its keys; a run of rows is closed by a later row that is further away, or by a timer when the
    watermark gets there. A bucket's timer is that of the run due first. Closed runs leave the state."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", ", ".join(f"{c} array<{kind}>" for c, kind in RUN.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = pd.DataFrame({"key": new["key"], "begun_us": new["at_us"], "ended_us": new["at_us"], "rows": 1, "value": new["value"].fillna(0.0)})
        runs, last, grown = extended(self._held(), new, self.idle_ms * 1000)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._hold(runs[last])
        told = runs[~last | grown]
        yield self._told(told, np.where(last, "running", "closed")[told.index])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = self._due(held) <= timerValues.getCurrentWatermarkInMs()
        self._hold(held[~due])
        yield self._told(held[due], "closed")

    def _held(self) -> pd.DataFrame:
        held = self.runs.get() or [[] for _ in RUN]
        return pd.DataFrame({c: np.array(values, "float64" if kind == "double" else "int64") for (c, kind), values in zip(RUN.items(), held)})

    def _hold(self, runs: pd.DataFrame) -> None:
        if runs.empty:
            self.runs.clear()
            return
        self.runs.update(tuple(runs[c].tolist() for c in RUN))
        self.handle.registerTimer(int(self._due(runs).min()))

    def _due(self, runs: pd.DataFrame) -> pd.Series:
        return -(-runs["ended_us"] // 1000) + self.idle_ms + 1

    @staticmethod
    def _told(runs: pd.DataFrame, state) -> pd.DataFrame:
        return runs.assign(state=state)[["key", "state", *list(RUN)[1:]]]

    def close(self) -> None:
        pass


def extended(held: pd.DataFrame, new: pd.DataFrame, idle_us: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The runs of held runs, one a key at most, and of new rows by time; which are their key's last, which have new rows."""
    both = pd.concat([held, new], ignore_index=True)
    order = np.lexsort((both["begun_us"], both.index >= len(held), both["key"]))  # of a key what is held comes first
    key, begun, ended, rows, value = (both[c].to_numpy()[order] for c in RUN)
    first = np.append(True, key[1:] != key[:-1])
    until = np.maximum(ended, ended[first][np.cumsum(first) - 1])  # the key's latest so far: new rows ascend
    begins = first | np.append(True, begun[1:] - until[:-1] > idle_us)
    at = np.flatnonzero(begins)
    sums = np.bincount(np.cumsum(begins) - 1, value)
    runs = pd.DataFrame({"key": key[at], "begun_us": np.minimum.reduceat(begun, at), "ended_us": np.maximum.reduceat(ended, at), "rows": np.add.reduceat(rows, at), "value": sums})
    return runs, np.append(key[at][1:] != key[at][:-1], True), np.logical_or.reduceat(order >= len(held), at)


def engagement(events: DataFrame, key: str, time: str, value: str, idle_ms: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """key, state (running or closed), begun, ended, rows, value of each key's runs of rows, by keyed state with timers. Rows
    with a null key or time don't count; null values count as rows of value 0. A checkpoint keeps the number of buckets that
    it was begun with."""
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = F.col(time).cast("timestamp")
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), at.alias("at"), F.unix_micros(at).alias("at_us"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    told = rows.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(Engagement(idle_ms), "key long, state string, begun_us long, ended_us long, rows long, value double", outputMode="Append", timeMode="EventTime")
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return told.select("key", "state", moment("begun_us").alias("begun"), moment("ended_us").alias("ended"), "rows", "value")
