"""Vector similarity to a few probes, and its percentile within the pool."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import free_name, row_numbers


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def cosine_topk(vector: Column, probes: list[list[float]], k: int = 3) -> Column:
    """Mean of the k largest cosines to the probes, at least 0. Stays in the JVM; for few probes."""
    sims = F.array(*[cosine(vector, F.array(*[F.lit(float(x)) for x in p])) for p in probes])
    top = F.slice(F.sort_array(sims, asc=False), 1, min(k, len(probes)))
    return F.greatest(F.lit(0.0), F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top))


def similarity(vectors: DataFrame, probes: np.ndarray, k: int = 3, column: str = "embedding") -> DataFrame:
    """Adds `raw`: the mean of the k largest cosines to the probes as a 32-bit float, by matrix products over
    Arrow batches. A null vector has a null raw."""
    ship(vectors.sparkSession)
    unit = probes.astype(np.float32)
    unit = unit / (np.linalg.norm(unit, axis=1, keepdims=True) + 1e-9)
    k = min(k, len(unit))

    @F.pandas_udf("float")
    def score(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan, np.float32)
        ok = v.notna().to_numpy()
        if ok.any():
            m = np.stack(v[ok].to_numpy()).astype(np.float32)
            m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-9
            out[ok] = np.clip(np.sort(m @ unit.T, axis=1)[:, -k:].mean(axis=1), 0, None)
        return pd.Series(out).astype(object).where(ok, None)

    return vectors.withColumn("raw", score(F.col(column)))


def pool_percentile(rows: DataFrame, value: str = "raw", order: str = "row_idx", name: str = "semantic") -> DataFrame:
    """Adds place / (n - 1) in the whole pool by value, ties by `order`; 0 in a pool of one. Nulls stay null. Rows are
    written once, so they had better hold no more than what is needed.

    No window over everything: places come from range partitions and the counts before them."""
    place = free_name(rows, "place")
    known = row_numbers(rows.where(F.col(value).isNotNull()), [F.col(value), F.col(order)], place)
    n = known.count()
    share = (F.col(place) / F.lit(n - 1)).cast("float").cast("double") if n > 1 else F.lit(0.0)
    done = known.withColumn(name, share).drop(place)
    return done.unionByName(rows.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def valid_artifacts(vectors: DataFrame, ids: DataFrame | None, probes: np.ndarray | None) -> bool:
    """Do vectors, the list of ids (where it is apart from them) and probes belong together: as many ids as vectors, one
    dimension?"""
    if probes is None or not len(probes):
        return False
    sizes = vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    return sizes["n"] > 0 and sizes["low"] == sizes["high"] == probes.shape[1] and (ids is None or sizes["n"] == ids.count())


def latest_by_id(vectors: DataFrame, key: str = "candidate_id", order: str = "row_idx") -> DataFrame:
    """Of rows with one id the last."""
    return vectors.groupBy(key).agg(F.max_by(F.struct(*[c for c in vectors.columns if c != key]), order).alias("r")).select(key, "r.*")
