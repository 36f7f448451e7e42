"""Vector expressions over array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-12))


def relevance(distance: Column) -> Column:
    """A distance as a score in (0, 1]."""
    return 1.0 / (1.0 + distance)


def distance_of(score: Column) -> Column:
    return 1.0 / F.greatest(score, F.lit(1e-9)) - 1.0


def entropy(distances: Column, temperature: float) -> Column:
    """Entropy of the softmax over negated distances; null for an empty array."""
    low = F.array_min(distances)
    weight = F.transform(distances, lambda d: F.exp(-(d - low) / F.lit(temperature)))
    total = _sum(weight)
    p = F.transform(weight, lambda w: w / total)
    return F.when(F.size(distances) > 0, -_sum(F.transform(p, lambda x: x * F.log(x + F.lit(1e-12)))))


def late_fusion(base: Column, refined: Column, query: Column, beta: float) -> Column:
    return (1 - beta) * cosine(base, query) + beta * cosine(refined, query)
