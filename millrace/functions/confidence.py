"""Confidence algebra: every function is a column expression or an aggregate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def aggregate_confidence(c: Column) -> Column:
    """70 % of the weakest and 30 % of the mean of a group; 0 for an empty one."""
    return F.coalesce(F.round(0.7 * F.min(c) + 0.3 * F.avg(c), 4), F.lit(0.0))


def band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.55, "medium").otherwise("low")


def noisy_or(strength: Column) -> Column:
    """1 - product(1 - s) of a group, each strength clamped to [0, 1]."""
    return 1 - F.product(1 - clamp(strength))


def corroboration(base: Column, documents: Column) -> Column:
    """A base confidence raised by further documents, never above 1."""
    return base + (1 - base) * (1 - F.pow(F.lit(0.5), documents - 1)) * 0.5


def recency(age_days: Column, half_life: float, undated: float = 0.5) -> Column:
    """Half after one half-life; future dates count as today; undated rows get ``undated``."""
    decayed = F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / half_life)
    return F.when(age_days.isNotNull(), decayed).otherwise(F.lit(undated))
