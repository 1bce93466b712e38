"""Similarity, boost and display-score column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scoring constants of the graph and of the request-time scores.
TAG_WEIGHT = 0.5
VECTOR_WEIGHT = 0.5
CORE_MIN = 0.05
BRANCH_VECTOR_WEIGHT = 0.7
BRANCH_NEW_TAG_BONUS = 0.1
BRANCH_BONUS_CAP = 0.3
BRANCH_BASE = 0.1
BRANCH_MIN = 0.15
K_MAX = 40
PER_TAG_MIN = 3
CORE_PER_TAG = 4
POOL_PER_TAG = 8
BOOST_FACTOR = 1.30
DEFAULT_DISTANCE = 0.5

ROUND_DIGITS = 6


def jaccard_from_counts(n_shared: Column, n_a: Column, n_b: Column) -> Column:
    """|A∩B| / |A∪B| from set sizes; 0 when either set is empty."""
    return F.when((n_a == 0) | (n_b == 0), F.lit(0.0)).otherwise(n_shared / (n_a + n_b - n_shared))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two tag arrays."""
    shared = F.size(F.array_intersect(a, b))
    return jaccard_from_counts(shared, F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in DOUBLE; 0 for a zero vector, null when either side is missing."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).when(norm == 0, F.lit(0.0))


def boost(score: Column, flagged: Column, enabled: Column) -> Column:
    """Lift the score of flagged items, never above 1."""
    on = F.coalesce(flagged, F.lit(False)) & F.coalesce(enabled, F.lit(False))
    return F.when(on, F.least(F.lit(1.0), score * F.lit(BOOST_FACTOR))).otherwise(score)


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def distance_to_score(distance: Column) -> Column:
    """clamp(1 − d, 0, 1); only a missing distance takes the default."""
    return _clamp(1 - F.coalesce(distance, F.lit(DEFAULT_DISTANCE)), 0.0, 1.0)


def _tenths(c: Column) -> Column:
    """Rounded to one digit, half away from zero, as SQL does it: 3.4499999999999997, which is 0.345 * 10, counts as 3.45."""
    return F.round(c * 10) / 10


def graph_connection_score(score: Column, shared_tags: Column) -> Column:
    """1–10 display score of a graph suggestion: base plus a bonus per distinct shared tag."""
    bonus = F.least(F.size(F.array_distinct(shared_tags)) * F.lit(0.3), F.lit(1.0))
    return _tenths(_clamp(score * 9 + bonus, 1.0, 10.0))


def vector_connection_score(distance: Column) -> Column:
    """1–10 display score of a vector suggestion."""
    return _tenths(_clamp((1 - F.coalesce(distance, F.lit(DEFAULT_DISTANCE))) * 10, 1.0, 10.0))


def relevance(distance: Column) -> Column:
    """Occasion relevance on a 0–10 scale, not clamped."""
    return _tenths((1 - F.coalesce(distance, F.lit(DEFAULT_DISTANCE))) * 10)


def connection_text(shared_tags: Column) -> Column:
    return F.concat(F.lit("Connected through: "), F.array_join(F.slice(shared_tags, 1, 4), ", "))


def transition_strength(n_shared: Column) -> Column:
    return F.when(n_shared >= 3, "STRONG").when(n_shared >= 1, "MODERATE").otherwise("WEAK")


def score_band(score: Column) -> Column:
    return F.when(score >= 7, "high").when(score >= 4, "mid").otherwise("low")


def score_action(a: Column, b: Column) -> Column:
    """Dual-scorer rule: both weak → removed, far apart → flagged (and kept), else kept."""
    return (
        F.when((a <= 2) & (b <= 2), "removed")
        .when(F.abs(a - b) >= 3, "flagged")
        .otherwise("kept")
    )
