"""Column helpers for values that may be missing: nulls only, no NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nz(c: Column) -> Column:
    """0 for null."""
    return F.coalesce(c, F.lit(0.0))


def truthy(p: Column) -> Column:
    """A predicate whose unknown is false."""
    return F.coalesce(p, F.lit(False))


def flag(value: Column, mask: Column) -> Column:
    """1 or 0 where ``value`` is known, else null."""
    return F.when(value.isNotNull(), truthy(mask).cast("int"))


def ratio(x: Column, y: Column) -> Column:
    """x / y where y is above 0, else null."""
    return F.when(y > 0, x / y)


def safe_div(x: Column, y: Column) -> Column:
    """x / y; 0 where y is null or 0."""
    return F.when(y.isNull() | (y == 0), F.lit(0.0)).otherwise(x / y)


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether two numbers agree; false if one is missing."""
    return truthy(F.abs(a - b) <= tolerance)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """``x`` within bounds; null stays null."""
    bounded = x
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(x.isNotNull(), bounded)


def finite(x: Column) -> Column:
    return truthy(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of x w over sum of w, over rows with a value and a weight above 0."""
    used = truthy(x.isNotNull() & (w > 0))
    return F.try_divide(F.sum(F.when(used, x * w)), F.sum(F.when(used, w)))


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def append_tag(tags: Column, mask: Column, tag: str) -> Column:
    """``tag`` appended to a list of tags joined by bars, where ``mask`` holds."""
    return F.when(truthy(mask), F.concat_ws("|", F.when(tags != "", tags), F.lit(tag))).otherwise(tags)
