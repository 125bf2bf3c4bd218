"""Statistics of a row against the earlier rows of the same entity.

An entity has one row per week, so these window partitions stay small no
matter how many events the entity has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from railwatch.functions.scalars import drift_scale

Z_CAP = 5.0
MIN_PRIOR = 2


def earlier_rows(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def prior_count(value: Column, frame) -> Column:
    return F.count(value).over(frame)


def prior_zscore(value: Column, frame) -> Column:
    """z of ``value`` against the non-null earlier values; null below two of them."""
    low, high = F.min(value).over(frame), F.max(value).over(frame)
    flat = F.when(value == low, 0.0).otherwise(Z_CAP)
    scaled = (value - F.avg(value).over(frame)) / F.stddev_samp(value).over(frame)
    return F.when(value.isNull() | (prior_count(value, frame) < MIN_PRIOR), None).when(low == high, flat).otherwise(scaled)


def drift_score(zscores: Sequence[Column]) -> Column:
    """Mean of the available |z| on a 0-100 scale; null where none is available."""
    present = [F.when(z.isNotNull(), 1).otherwise(0) for z in zscores]
    total = sum((F.coalesce(F.abs(z), F.lit(0.0)) for z in zscores), F.lit(0.0))
    count = sum(present, F.lit(0))
    return F.when(count > 0, drift_scale(total / count))
