"""Vector functions on arrays, from zip_with and aggregate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 for an empty vector or a zero norm."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    both = norm(x) * norm(y)
    return F.when((n <= 0) | (both == 0), F.lit(0.0)).otherwise(dot(x, y) / both)


def similarity(distance: Column) -> Column:
    """1 - d/2 for distances up to 4 (never under 0), else 1/(1+d); 0 if not finite."""
    bad = F.isnan(distance) | distance.isNull() | (F.abs(distance) == float("inf"))
    return F.when(bad, 0.0).when(distance <= 4, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))).otherwise(1 / (1 + distance))


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def blend(parts) -> Column:
    """Weighted sum of (vector, weight) pairs, normalised."""
    def scale(v, w):
        return F.transform(v, lambda x: x.cast("double") * w)

    scaled = [scale(v, w) for v, w in parts]
    out = scaled[0]
    for s in scaled[1:]:
        out = F.zip_with(out, s, lambda x, y: x + y)
    return l2_normalised(out)


def fitted(a: Column, dim: int) -> Column:
    """The vector, or zeros where its length is not ``dim``."""
    return F.when(F.size(a) == dim, a).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dim))


def low_signal(a: Column, least: float = 1e-6) -> Column:
    """No vector, an empty one, one with a null or non-finite component, or a norm of at most ``least``."""
    odd = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) == 0) | odd | (norm(a) <= least), F.lit(True))


def mean_pool(vectors: Column, dim: int) -> Column:
    """Normalised mean of an array of vectors of the right length."""
    ok = F.filter(vectors, lambda v: F.size(v) == dim)
    total = F.aggregate(ok, F.array_repeat(F.lit(0.0), dim), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return l2_normalised(F.transform(total, lambda x: x / F.greatest(F.size(ok), F.lit(1))))


#: What a vector's provenance does to its score.
PROVENANCE = {"ready": 1.0, "legacy": 0.97, "stale": 0.74, "dimension_mismatch": 0.50, "unavailable": 0.45, "zero": 0.45}


def provenance_factor(state: Column) -> Column:
    out = F.lit(1.0)
    for k, v in PROVENANCE.items():
        out = F.when(state == k, F.lit(v)).otherwise(out)
    return out
