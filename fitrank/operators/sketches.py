"""Approximate aggregates that merge: distinct counts, quantiles and frequent values as columns of a table of groups.

A table of sketches is written once, at the finest groups that are asked for; coarser groups add its rows up and never
read the data again. Distinct counts are HyperLogLog sketches, quantiles KLL sketches, frequent values a
table of counts of their most frequent items with a bound on what they miss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Registers of a distinct count as a power of two (about 1.6 % off), accuracy of quantiles, items of frequent values.
REGISTERS, ACCURACY, ITEMS = 12, 400, 4096


def _countable(rows: DataFrame, column: str) -> Column:
    """Whole numbers, texts and bytes are counted as they are, others by their text."""
    kind, value = rows.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    return value if isinstance(kind, (T.StringType, T.BinaryType)) else value.cast("string")


def sketched(rows: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = (), frequent: Sequence[str] = ()) -> DataFrame:
    """`by`, rows and a sketch a column: distinct_x, quantile_x, frequent_x. Nulls and NaN are in no sketch; a group without
    any value has a null quantile sketch."""
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    made = [F.count("*").alias("rows")]
    made += [F.hll_sketch_agg(_countable(rows, c), REGISTERS).alias(f"distinct_{c}") for c in distinct]
    made += [F.kll_sketch_agg_double(number(c), F.lit(ACCURACY)).alias(f"quantile_{c}") for c in quantiles]
    made += [F.call_function("approx_top_k_accumulate", F.col(f"`{c}`"), F.lit(ITEMS)).alias(f"frequent_{c}") for c in frequent]
    return rows.groupBy(*by).agg(*made)


def rolled_up(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups (of all rows, if `by` is empty), from those of finer ones."""
    merge = {"distinct": lambda c: F.hll_union_agg(c), "quantile": lambda c: F.kll_merge_agg_double(F.col(c)), "frequent": lambda c: F.call_function("approx_top_k_combine", F.col(c), F.lit(ITEMS))}
    made = [merge[c.partition("_")[0]](c).alias(c) for c in sketches.columns if c.partition("_")[0] in merge and "_" in c]
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *made)


def estimates(sketches: DataFrame, ranks: Sequence[float] = (0.5,), top: int = 10) -> DataFrame:
    """What sketches say: distinct_x a number, quantile_x an array of values at `ranks`, frequent_x an array of
    (item, count) of the `top` most frequent."""
    tell = {"distinct": lambda c: F.hll_sketch_estimate(c), "quantile": lambda c: F.kll_sketch_get_quantile_double(c, F.array(*[F.lit(float(r)) for r in ranks])), "frequent": lambda c: F.slice(F.filter(F.call_function("approx_top_k_estimate", F.col(c), F.lit(top + 1)), lambda i: i["item"].isNotNull()), 1, top)}
    return sketches.select(*[(tell[c.partition("_")[0]](c) if c.partition("_")[0] in tell and "_" in c else F.col(f"`{c}`")).alias(c) for c in sketches.columns])
