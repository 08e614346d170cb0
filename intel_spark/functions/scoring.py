"""Severity buckets, clamping, decay and evidence combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order.
SEVERITIES = ["low", "medium", "high", "critical"]


def severity_for(value: Column, thresholds: tuple[float, float, float, float]) -> Column:
    """four ascending thresholds to low/medium/high/critical, "none" below the first."""
    low, medium, high, critical = thresholds
    return (
        F.when(value >= critical, "critical").when(value >= high, "high").when(value >= medium, "medium").when(value >= low, "low").otherwise("none")
    )


def severity_for_confidence(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "critical").when(confidence >= 0.7, "high").when(confidence >= 0.5, "medium").otherwise("low")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1, F.lit(0)).cast("int")


def rank_severity(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def clamp(value: Column, low: float = 0.0, high: float = 0.99) -> Column:
    """F13"""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def noisy_or(weights: Column) -> Column:
    """one minus the product of the misses over an array of weights, to three places; nulls are no evidence."""
    present = F.filter(weights, lambda w: w.isNotNull())
    return F.round(1 - F.aggregate(present, F.lit(1.0), lambda acc, w: acc * (1 - clamp(w))), 3)


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def linear_decay(a: Column, b: Column, window_hours: float) -> Column:
    """1 at the same moment, 0 at the edge of the window."""
    gap = F.abs(hours_between(a, b))
    return F.when(gap > window_hours, F.lit(0.0)).otherwise(1 - gap / window_hours)


def half_decay(a: Column, b: Column, window_hours) -> Column:
    """1 at the same moment, one half at the edge of the window, 0 outside."""
    window = window_hours if isinstance(window_hours, Column) else F.lit(float(window_hours))
    gap = F.abs(hours_between(a, b))
    return F.when(gap > window, F.lit(0.0)).otherwise(1 - 0.5 * (gap / window))
