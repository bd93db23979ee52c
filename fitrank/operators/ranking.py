"""Score, exact order and top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import free_name, row_numbers, written
from .consistency import consistency_flags
from .engagement import with_engagement
from .fit import with_fit
from .texts import found_name

#: Columns that scoring reads.
INPUTS = ("candidate_id", "profile", "career_history", "education", "skills", "signals")
#: Columns that it adds; an input column of one of these names is replaced.
ADDED = ("flags", "fit", "multiplier", "score", "trace")


def score(candidates: DataFrame, profile, semantic: DataFrame | None = None, keep: tuple = ()) -> DataFrame:
    """Adds flags, fit, multiplier, score and trace (ADDED). A flagged profile scores 0 and its trace has only its flags
    and score; everyone else fit times multiplier. semantic: (candidate_id, semantic), one row an id; who has none is
    scored on texts. Without it a column `semantic` of the input counts, if there is one, and it stays.
    `keep`: columns of with_fit and with_engagement to have besides, of flagged profiles too."""
    own = [c for c in candidates.columns if c.lower() not in ADDED]
    used = "semantic" if semantic is None and "semantic" in own else free_name(candidates, "semantic_score")
    if semantic is not None:
        candidates = candidates.join(semantic.select("candidate_id", F.col("semantic").alias(used)), "candidate_id", "left")
    elif used != "semantic":
        candidates = candidates.withColumn(used, F.lit(None).cast("double"))
    # the input's columns travel under names of their own, so that none clashes with one of scoring's
    packed = candidates.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], *INPUTS, *[c for c in candidates.columns if c == found_name(profile)], F.col(used).alias("semantic"))
    rows = with_engagement(with_fit(packed.withColumn("flags", consistency_flags(profile)), profile), profile)
    flagged = F.size("flags") > 0
    rows = rows.withColumn("score", F.when(flagged, 0.0).otherwise(F.col("fit") * F.col("multiplier")))
    fields = [F.when(~flagged, F.col(f"fit_trace.{n}")).alias(n) for n in rows.schema["fit_trace"].dataType.names]
    fields += [F.when(~flagged, F.col(f"engagement_trace.{n}")).alias(n) for n in rows.schema["engagement_trace"].dataType.names]
    fields += [F.when(~flagged, F.col("multiplier")).alias("mult"), F.col("flags").alias("honeypot"), F.col("score").alias("score")]
    return rows.withColumn("trace", F.struct(*fields)).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], *ADDED, *keep)


def exact_round6(x: Column | str) -> Column:
    """Rounds the binary value to six places, halves to even, as Python does; Spark's own round works on the shortest
    decimal. The product with a million is split into its rounded value and its exact error, which decides where the
    value lies beside a half. Values beyond 4 billion stay as they are."""
    x = F.col(x) if isinstance(x, str) else x
    size = F.abs(x)
    product, spread = size * 1e6, size * 134217729.0
    high = spread - (spread - size)
    error = (high * 1e6 - product) + (size - high) * 1e6
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = F.when(up, whole + 1).otherwise(whole) / 1e6
    return F.when(F.isnan(x) | (size >= 4e9), x).otherwise(F.when(x < 0, -rounded).otherwise(rounded))


#: Rows beyond n that a ranking keeps until scores are rounded exactly.
SLACK = 1024
#: The longest ranking whose rows pass the driver; rank_all has no such bound.
MOST_BEST = 100_000


def contenders(scored: DataFrame, n: int, id_column: str = "candidate_id") -> tuple[float, DataFrame | None]:
    """(the score under which no row is among the n best, their ids or None if they are too many to be a small set).

    Only ids and scores are sorted: n + SLACK rows by Spark's own rounding, which is at most a millionth off. More than
    MOST_BEST are refused."""
    if n > MOST_BEST:
        raise ValueError(f"the best {MOST_BEST} at most; use rank_all")
    near = scored.select(F.col(id_column), F.col("score")).orderBy(F.round("score", 6).desc(), id_column).limit(n + SLACK)
    found = near.collect()
    if len(found) <= n or not n:
        return float("-inf"), scored.sparkSession.createDataFrame(found, near.schema).select(id_column) if len(found) < n + SLACK else None
    last = sorted((r["score"] for r in found), reverse=True)[n - 1]
    least = last - 2.5e-6
    # more rows than were looked at may lie so close to the n-th place; those of score 0 are in order already
    whole = len(found) < n + SLACK or found[-1]["score"] < least - 1e-6 or last == 0
    ids = [(r[id_column],) for r in found if r["score"] >= least]
    return least, scored.sparkSession.createDataFrame(ids, near.select(id_column).schema) if whole else None


def top_n(scored: DataFrame, n: int, id_column: str = "candidate_id") -> DataFrame:
    """The n best by score rounded to six places, ties by id; adds rank from 1. Repeated ids are rows each.

    Ids and scores are sorted first; whole rows are fetched only for those that may be among the n best."""
    least, ids = contenders(scored, n, id_column)
    rows = scored if ids is None else scored.join(F.broadcast(ids.distinct()), id_column, "left_semi")
    exact = rows.where(F.col("score") >= least).withColumn("score", exact_round6("score"))
    return numbered(exact.orderBy(F.desc("score"), id_column).limit(n), id_column)


def numbered(best: DataFrame, id_column: str = "candidate_id") -> DataFrame:
    """Adds rank from 1 to the few rows of a top-N."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_column)))


def rank_all(scored: DataFrame, id_column: str = "candidate_id", keep: tuple = ()) -> DataFrame:
    """Every row's id, rank and score (rounded to six places), and the columns named in `keep`; by range partitions and
    the counts before them. What is not kept is neither sorted nor stored."""
    # written, because the bounds of the ranges come from a pass of their own
    narrow = written(scored.select(F.col(id_column), exact_round6("score").alias("score"), *[c for c in keep if c not in (id_column, "score")]), "scores")
    placed = row_numbers(narrow, [F.desc("score"), F.col(id_column)], "rank")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int"))


def tie_break_violations(ranked: DataFrame, id_column: str = "candidate_id") -> DataFrame:
    """Adjacent rows of a top-N out of order: a rising score, or an equal one with a falling id."""
    w = Window.orderBy("rank")
    rows = ranked.select("rank", id_column, "score", F.lag("score").over(w).alias("last_score"), F.lag(id_column).over(w).alias("last_id"))
    return rows.where((F.col("score") > F.col("last_score")) | ((F.col("score") == F.col("last_score")) & (F.col(id_column) < F.col("last_id"))))


def without_vector(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates that have no vector."""
    return candidates.join(vectors.select("candidate_id"), "candidate_id", "left_anti")


def with_labels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates that are labelled."""
    return candidates.join(labels.select("candidate_id"), "candidate_id", "left_semi")
