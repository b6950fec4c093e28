"""Null handling, ratios and the small formulas of the indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE; null instead of a division by zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def share_or_zero(part: Column, whole: Column) -> Column:
    """Row share in percent, 0/0 counting as 0."""
    return F.coalesce(percent(part, whole), F.lit(0.0))


def iqr(q75: Column, q25: Column) -> Column:
    return q75 - q25


def harmonic_mean(a: Column, b: Column) -> Column:
    """Harmonic mean of two ratios; 0 when either is 0, null when either is null."""
    return F.when(a.isNull() | b.isNull(), None).when((a == 0) | (b == 0), 0.0).otherwise(2 * a * b / (a + b))


def clip_at_zero(value: Column) -> Column:
    """Missing and negative values become 0."""
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def damped_log(value: Column) -> Column:
    """Natural log with negative logs set to 1; log(0) counts as such a negative log."""
    return F.when(value == 0, 1.0).when(F.log(value) < 0, 1.0).otherwise(F.log(value))


def capped(value: Column, top: int) -> Column:
    return F.when(value > top, F.lit(top)).otherwise(value)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def decision_index(suitability: Column, density: Column, r: float = 0.5, k: float = 30.0) -> Column:
    """Where to look next: high where the area is suitable but few reports come in."""
    suitable = sigmoid(F.lit(k) * (suitability - 0.5))
    sparse = sigmoid(F.lit(-k) * (density - F.lit(r)))
    return sparse * (suitable + 0.5 * (1 - suitable))
