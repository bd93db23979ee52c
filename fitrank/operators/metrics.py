"""Ranking metrics over (group, pos, rel) rows; pos counts from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import group_places


def gain(rel: Column, pos: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(pos + 1)


def dcg(rows: DataFrame, group: str = "group") -> DataFrame:
    return rows.groupBy(group).agg(F.sum(gain(F.col("rel"), F.col("pos"))).alias("dcg"))


def all_metrics(rows: DataFrame, ks=(10, 50), group: str = "group") -> DataFrame:
    """ndcg_k for each k (against the ideal order of the group's whole pool; 0 without one), p_k (rel >= 3, by k even in
    a shorter list), ap (rel >= 1, by hits found; 0 without) and composite (.50 .30 .15 .05).

    No task holds a group: the ideal order's first rows are picked before anything is shuffled, and hits are counted by
    their places in one order of all hits."""
    narrow = rows.select(F.col(group), "pos", "rel")
    ideal = Window.partitionBy(group).orderBy(F.desc("rel"))
    first = narrow.withColumn("best", F.row_number().over(ideal)).where(F.col("best") <= max(ks))
    ideals = first.groupBy(group).agg(*[F.sum(F.when(F.col("best") <= k, gain(F.col("rel"), F.col("best"))).otherwise(0.0)).alias(f"i_{k}") for k in ks])
    found = group_places(narrow.where("rel >= 1"), group, [F.col("pos")], "hits")
    precision = found.groupBy(group).agg(F.avg(F.col("hits") / F.col("pos")).alias("ap"))
    sums = [F.sum(F.when(F.col("pos") <= k, gain(F.col("rel"), F.col("pos"))).otherwise(0.0)).alias(f"d_{k}") for k in ks]
    sums += [F.count_if((F.col("pos") <= k) & (F.col("rel") >= 3)).alias(f"h_{k}") for k in ks]
    g = narrow.groupBy(group).agg(*sums)
    for more in (ideals, precision):
        other = more.withColumnRenamed(group, "of")
        g = g.join(other, F.col(group).eqNullSafe(F.col("of")), "left").drop("of")
    out = [F.when(F.col(f"i_{k}") > 0, F.col(f"d_{k}") / F.col(f"i_{k}")).otherwise(0.0).alias(f"ndcg_{k}") for k in ks]
    out += [(F.col(f"h_{k}") / k).alias(f"p_{k}") for k in ks] + [F.coalesce("ap", F.lit(0.0)).alias("ap")]
    done = g.select(group, *out)
    first_k, second_k = ks[0], ks[1] if len(ks) > 1 else ks[0]
    return done.withColumn("composite", 0.5 * F.col(f"ndcg_{first_k}") + 0.3 * F.col(f"ndcg_{second_k}") + 0.15 * F.col("ap") + 0.05 * F.col(f"p_{first_k}"))


def precision_at(rows: DataFrame, k: int, group: str = "group") -> DataFrame:
    """0 for k of 0 or less."""
    p = F.count_if((F.col("pos") <= k) & (F.col("rel") >= 3)) / k if k > 0 else F.lit(0.0) * F.count("*")
    return rows.groupBy(group).agg(p.alias("precision"))


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds pos, the place from 1 within the group."""
    return group_places(rows, group, order, "pos").withColumn("pos", F.col("pos").cast("long"))
