"""Scores as columns. All stay within generated code; rounding is to 6 places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.model import Decay

HOUR_US = 3_600_000_000.0


def recency(occurred_us: Column, accessed_us: Column, access_count: Column, now_us: int, base: float = 168.0, boost: float = 24.0) -> Column:
    """exp(-t / S): t hours since the later of occurrence and access, not negative; S grows with the logarithm of accesses."""
    hours = F.greatest(F.lit(0.0), (F.lit(now_us) - F.greatest(occurred_us, F.coalesce(accessed_us, occurred_us))) / HOUR_US)
    stability = F.lit(base) * (1 + F.lit(boost / base) * F.log1p(access_count.cast("double")))
    return F.when(stability <= 0, 0.0).otherwise(F.exp(-hours / stability))


def recency_linear(occurred_us: Column, access_count: Column, now_us: int, base: float = 168.0, boost: float = 24.0) -> Column:
    """The variant whose stability grows linearly with accesses."""
    stability = F.lit(base) + access_count * F.lit(boost)
    hours = F.greatest(F.lit(0.0), (F.lit(now_us) - occurred_us) / HOUR_US)
    return F.when(stability <= 0, 0.0).otherwise(F.exp(-hours / stability))


def importance(hint: Column, access_count: Column, in_degree: Column) -> Column:
    part = lambda c: F.least(F.lit(0.2), 0.05 * F.log1p(c.cast("double")))
    return F.least(F.lit(1.0), F.coalesce(hint / 10.0, F.lit(0.5)) + part(access_count) + part(in_degree))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for empty, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm)


def relevance(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1; 0.5 where there is none."""
    near = cosine(a, b)
    return F.when(near.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def composite(recency_score: Column, importance_score: Column, relevance_score: Column, affinity: Column, d: Decay = Decay()) -> Column:
    """Weighted mean; 0 without weights."""
    weights = d.recency_weight + d.importance_weight + d.relevance_weight + d.affinity_weight
    if weights <= 0:
        return F.lit(0.0)
    total = d.recency_weight * recency_score + d.importance_weight * importance_score + d.relevance_weight * relevance_score + d.affinity_weight * affinity
    return total / weights


def user_affinity(preference: Column, recency_score: Column, overlap: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * preference + 0.3 * recency_score + 0.3 * overlap))


def boosted(decay: Column, weight: Column) -> Column:
    """A neighbour's score, raised by the weight of the edge that led to it."""
    return F.least(F.lit(1.0), decay * (1 + weight * 0.1))

