"""Workbooks as a data source: spark.read.format("workbook").load(folder).

A partition is a range of rows of one file, by the size that the sheet states (a file that states none is one partition);
a task streams through the sheet and keeps a row at a time. Cells are texts, columns are the first file's header.
"""

from __future__ import annotations

import re
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship
from ..storage import filesystem
from .readers import _NS, _active_sheet, stream_sheet

#: Rows of a partition; a sheet has 1,048,576 at most.
PARTITION_ROWS = 50_000
#: Most ranges of a sheet, and of a long one. A range is streamed from the sheet's begin, so ranges of a fixed size would
#: cost the square of a sheet's rows; a longer sheet has longer ranges instead.
MOST_RANGES, LONG_SHEET, MOST_LONG_RANGES = 16, 4096, 4


class _Rows(InputPartition):
    def __init__(self, uri: str, first: int, last: int | None):
        self.uri, self.first, self.last = uri, first, last


def _opened(uri: str):
    store, path = filesystem(uri)
    return store.open_input_file(path)


def _files(uri: str) -> list[str]:
    """Workbooks in a folder, or the one that uri names, in order of their names."""
    from pyarrow import fs

    store, path = filesystem(uri)
    if store.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.lower().endswith(".xlsx"))
    return [f"{uri.rstrip('/')}/{n}" for n in names]


def _stated_rows(z: zipfile.ZipFile) -> int | None:
    """Rows by the dimension that a sheet states at its begin."""
    with z.open(_active_sheet(z, _NS)) as f:
        found = re.search(rb'<dimension ref="[A-Z]+[0-9]+:[A-Z]+([0-9]+)"', f.read(4096))
    return int(found[1]) if found else None


def _header(uri: str) -> list[str]:
    with _opened(uri) as f, zipfile.ZipFile(f) as z:
        return next(stream_sheet(z, 0, 1), [])


class WorkbookSource(DataSource):
    """Options: path (a workbook or a folder of them), partitionRows (rows of a range at least), limit (rows of each file, 0 for all)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        names = [n for n in (_header(files[0]) if files else []) if n]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError("a header names a column twice")
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self.options, schema)


class WorkbookReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.names = options["path"], schema.fieldNames()
        self.rows, self.limit = int(options.get("partitionRows", PARTITION_ROWS)), int(options.get("limit", 0))

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri in _files(self.path):
            with _opened(uri) as f, zipfile.ZipFile(f) as z:
                stated = _stated_rows(z)
            end = self.limit + 1 if self.limit else None
            if stated is None:
                out.append(_Rows(uri, 1, end))
                continue
            # the last range is open: a sheet may hold more than it states
            stop = max(2, min(stated, end or stated))
            step = max(self.rows, -(-stop // (MOST_RANGES if stop <= LONG_SHEET else MOST_LONG_RANGES)))
            bounds = list(range(1, stop, step))
            out += [_Rows(uri, a, a + step if i + 1 < len(bounds) else end) for i, a in enumerate(bounds)]
        return out

    def read(self, partition: _Rows | None):
        if partition is None:  # no file
            return
        with _opened(partition.uri) as f, zipfile.ZipFile(f) as z:
            head = next(stream_sheet(z, 0, 1), [])
            places = [head.index(n) if n in head else None for n in self.names]
            for row in stream_sheet(z, partition.first, partition.last):
                if any(row):
                    yield tuple(None if p is None else row[p] if p < len(row) else "" for p in places)


def register_workbooks(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WorkbookSource)
