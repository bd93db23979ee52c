"""The whole ranking: candidates and vectors in, the explained best N out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.explain import explained
from ..operators.ranking import score, top_n
from ..operators.semantic import latest_by_id, pool_percentile, similarity, valid_artifacts
from ..storage import written


def semantic_scores(vectors: DataFrame, probes: np.ndarray, k: int = 3) -> DataFrame:
    """candidate_id and the pool percentile of its last vector."""
    raw = similarity(vectors, probes, k).select("candidate_id", "row_idx", "raw")
    return latest_by_id(pool_percentile(raw)).select("candidate_id", "semantic")


def usable_scores(vectors: DataFrame, probes: np.ndarray | None, ids: DataFrame | None = None) -> DataFrame | None:
    """Semantic scores, or None where vectors, probes and ids (a separate list, if there is one) don't belong together."""
    return semantic_scores(vectors, probes) if valid_artifacts(vectors, ids, probes) else None


def scored_pool(candidates: DataFrame, profile, semantic: DataFrame | None = None) -> DataFrame:
    """candidate_id, score, trace and a fingerprint of the row, written once for the whole pool: a few numbers a row, no
    texts. All that follows a scoring reads this."""
    return written(score(candidates, profile, semantic).select("candidate_id", "score", "trace", _fingerprint().alias("fingerprint")), "scores")


def _fingerprint() -> Column:
    return F.xxhash64("profile", "career_history", F.to_json("signals"))


#: Ids that a condition names; more are joined.
MOST_NAMED = 5000


def only(candidates: DataFrame, best: DataFrame, n: int) -> DataFrame:
    """The candidates whose ids are among best's n rows. Few ids are named in a condition, which Spark brings down to the
    tables that candidates are made of, so that no others are built."""
    ids = best.select("candidate_id").distinct()
    if n > MOST_NAMED:
        return candidates.join(ids, "candidate_id", "left_semi")
    return candidates.where(F.col("candidate_id").isin([r["candidate_id"] for r in ids.collect()]))


def best_of(pool: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """The n best of a scored pool with their profiles, roles, signals and ranks."""
    best = written(top_n(pool, n), "best")
    rows = only(candidates, best, n).select("candidate_id", "profile", "career_history", "signals").withColumn("fingerprint", _fingerprint())
    best = F.broadcast(best)  # n rows
    # alike rows of one id meet each of their ranks, of which one stays
    return rows.join(best, ["candidate_id", "fingerprint"]).dropDuplicates(["rank"]).drop("fingerprint")


def rank_candidates(candidates: DataFrame, profile, n: int = 100, vectors: DataFrame | None = None, probes: np.ndarray | None = None, ids: DataFrame | None = None) -> DataFrame:
    """candidate_id, rank, score, reasoning, trace. Vectors that don't belong together are left out, and texts alone
    decide. The pool is scored once; whole rows are fetched only for the n best."""
    semantic = usable_scores(vectors, probes, ids) if vectors is not None else None
    best = best_of(scored_pool(candidates, profile, semantic), candidates, n)
    return explained(best).select("candidate_id", "rank", "score", "reasoning", "trace")


def candidate_audit(ranked: DataFrame, candidate_id: str) -> DataFrame:
    """One ranked row with its profile, roles and signals, and each part of its trace as a column."""
    return ranked.where(F.col("candidate_id") == candidate_id).select("candidate_id", "rank", "profile", "career_history", "signals", "trace.*")


def display_rows(ranked: DataFrame) -> DataFrame:
    """What a leaderboard shows: texts, by rank."""
    years = F.concat(F.format_string("%.1f", F.coalesce("profile.years_of_experience", F.lit(0.0))), F.lit(" yrs"))
    return ranked.select("rank", "candidate_id", F.coalesce("profile.current_title", F.lit("")).alias("title"), years.alias("experience"), F.format_string("%.6f", "score").alias("score"), "reasoning")
