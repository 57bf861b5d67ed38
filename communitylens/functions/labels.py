"""Threshold labels, ratios and vector access as column expressions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from communitylens import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentiment_class(score: Column | str, cutoff: float = K.SENTIMENT_CUTOFF) -> Column:
    score = _col(score)
    return F.when(score >= cutoff, "positive").when(score <= -cutoff, "negative").otherwise("neutral")


def sentiment_sign(score: Column | str, cutoff: float = K.SENTIMENT_CUTOFF) -> Column:
    score = _col(score)
    return F.when(score >= cutoff, 1.0).when(score <= -cutoff, -1.0).otherwise(0.0)


def score_label(score: Column | str, threshold: float = K.QUALITY_THRESHOLD, side: str = "at_least") -> Column:
    """1 when the score is at least (or below) the threshold; a missing score is 0."""
    score = _col(score)
    if side not in ("at_least", "below"):
        raise ValueError(f"side must be 'at_least' or 'below', not {side!r}")
    hit = score >= threshold if side == "at_least" else score < threshold
    return F.when(hit, 1).otherwise(0)


def guarded_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0.0 where the whole is zero or missing."""
    part, whole = _col(part), _col(whole)
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def class_probability(probability: Column | str, index: int = 1) -> Column:
    return F.get(vector_to_array(_col(probability)), F.lit(index))


def argmax(weights: Column | str) -> Column:
    """0-based position of the largest weight, the first on ties, -1 when empty."""
    weights = _col(weights)
    return (
        F.when(F.size(weights) > 0, F.array_position(weights, F.array_max(weights)) - 1)
        .otherwise(-1).cast("int")
    )


def shared_size(a: Column | str, b: Column | str) -> Column:
    """|A and B| of two small arrays."""
    return F.size(F.array_intersect(_col(a), _col(b)))


def joint_size(a: Column | str, b: Column | str) -> Column:
    """|A or B| of two small arrays."""
    return F.size(F.array_union(_col(a), _col(b)))


def jaccard(shared: Column | str, joint: Column | str) -> Column:
    return guarded_ratio(shared, joint)
