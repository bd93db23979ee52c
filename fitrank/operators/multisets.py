"""Set operations on rows that may repeat, with their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_counts(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct row of `columns` (nulls are equal) with a_rows and b_rows. One pass over both: counts are added up
    before anything is shuffled, so a row that fills a third of a side is one row a task; equal hashes are no equality, the
    columns themselves are compared."""
    side = lambda df, n: df.select(*[F.col(f"`{c}`") for c in columns], F.lit(1 - n).cast("long").alias("in_a"), F.lit(n).cast("long").alias("in_b"))
    both = side(a, 0).unionByName(side(b, 1))
    return both.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum("in_a").alias("a_rows"), F.sum("in_b").alias("b_rows"))


def multiset_operations(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct row with the number of times it is in INTERSECT ALL (common), in a EXCEPT ALL b (only_a), in b EXCEPT
    ALL a (only_b) and in UNION ALL (united)."""
    n = multiset_counts(a, b, columns)
    zero = F.lit(0).cast("long")
    return n.select(*[F.col(f"`{c}`") for c in columns], F.least("a_rows", "b_rows").alias("common"), F.greatest(F.col("a_rows") - F.col("b_rows"), zero).alias("only_a"), F.greatest(F.col("b_rows") - F.col("a_rows"), zero).alias("only_b"), (F.col("a_rows") + F.col("b_rows")).alias("united"))


def repeated(counted: DataFrame, times: str, columns: Sequence[str]) -> DataFrame:
    """Rows as often as `times` says, as the SQL operations return them."""
    return counted.where(F.col(times) > 0).select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias("_n")).drop("_n")
