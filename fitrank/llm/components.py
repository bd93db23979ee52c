"""Connected components over DataFrames of links: smallest labels spread along links and by pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that links reach. Nodes without links have no row.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest
    path. Nothing but one count a round reaches the driver."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "near").alias("next"))
        spread = written(spread, "spread")
        jump = spread.select(F.col("node").alias("via"), F.col("next").alias("far"))
        rounds = written(spread.join(jump, spread.next == jump.via).select("node", F.least("next", "far").alias("component"), (F.col("component") != F.least("next", "far")).alias("changed")), "labels")
        labels = rounds.select("node", "component")
        if rounds.where("changed").isEmpty():
            return labels
