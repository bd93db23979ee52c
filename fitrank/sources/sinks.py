"""Writers: the ranking as one CSV file, vectors as Parquet, small frames as Markdown."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ranking_rows(ranked: DataFrame) -> DataFrame:
    """candidate_id, rank, score (six places), reasoning. `ranked` has N rows at most."""
    return ranked.select("candidate_id", "rank", F.format_string("%.6f", "score").alias("score"), "reasoning")


def write_ranking(ranked: DataFrame, path: str) -> None:
    ranking_rows(ranked).coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").csv(path, header=True, escape='"')


def ranking_csv(ranked: DataFrame) -> str:
    """The same content in memory, for downloads."""
    return ranking_rows(ranked).orderBy("rank").toPandas().to_csv(index=False)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("candidate_id", "row_idx", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, in any store that Spark reaches."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_artifacts(vectors: DataFrame, probes, folder: str) -> None:
    """Vectors, the list of their ids and the probes, each as a table of its own."""
    write_vectors(vectors, f"{folder}/vectors")
    vectors.select("candidate_id").write.mode("overwrite").parquet(f"{folder}/ids")
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(probes)]
    vectors.sparkSession.createDataFrame(rows, "place int, embedding array<float>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/probes")


def _letters(column: int) -> str:
    """The name of a column, from 1."""
    name = ""
    while column > 0:
        column, rest = divmod(column - 1, 26)
        name = chr(65 + rest) + name
    return name or "A"


def workbook(rows: list[list[str]]) -> bytes:
    """A spreadsheet of one sheet of texts."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>' for x in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{ns}"><dimension ref="A1:{_letters(max(map(len, rows), default=1))}{max(1, len(rows))}"/><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


#: Rows of a report's table; a frame of more is no report.
MOST_REPORT_ROWS = 10_000


def markdown(frame: DataFrame, title: str) -> str:
    """A report table of a small frame, whole; more than MOST_REPORT_ROWS rows are refused."""
    rows = frame.limit(MOST_REPORT_ROWS + 1).collect()
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError(f"a report's table has at most {MOST_REPORT_ROWS} rows")
    lines = [f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
