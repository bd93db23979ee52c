"""Scores new profiles as they arrive, on texts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import score
from ..sources.readers import from_variants


def stream_scores(spark: SparkSession, folder: str, profile, signals_key: str = "signals") -> DataFrame:
    """A streaming frame of scored candidates from JSON-lines files that appear in a folder."""
    lines = spark.readStream.text(folder).where(F.trim("value") != "")
    parsed = lines.select(F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    return score(from_variants(parsed, signals_key=signals_key), profile)
