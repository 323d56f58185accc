"""Range labels and equal-width buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _ladder(c: Column, steps: list[tuple], top: str, first_open: bool) -> Column:
    label = None
    for i, (bound, name) in enumerate(steps):
        hit = c < bound if (first_open and i == 0) else c <= bound
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return F.when(c.isNotNull(), label.otherwise(F.lit(top)))


def age_range(c: Column) -> Column:
    return _ladder(c.cast("int"), K.AGE_RANGES, K.AGE_TOP, first_open=False)


def income_range(c: Column) -> Column:
    return _ladder(c, K.INCOME_RANGES, K.INCOME_TOP, first_open=True)


def household_range(c: Column) -> Column:
    return _ladder(c.cast("int"), K.HOUSEHOLD_RANGES, K.HOUSEHOLD_TOP, first_open=False)


def land_range(c: Column) -> Column:
    return _ladder(c, K.LAND_RANGES, K.LAND_TOP, first_open=True)


def equal_width(c: Column, low: Column, high: Column, buckets: int = 10) -> Column:
    """Midpoint of the bucket of ``c`` among equal buckets of [low, high].

    A constant column (low = high) is returned unchanged.
    """
    width = (high - low) / F.lit(buckets)
    index = F.least(F.floor((c - low) / F.nullif(width, F.lit(0.0))), F.lit(buckets - 1))
    midpoint = F.bround(low + (index + F.lit(0.5)) * width, 2)
    return F.when(low == high, c).when(c.isNotNull(), midpoint)
