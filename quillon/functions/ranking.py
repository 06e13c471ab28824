"""Ranks within groups that may be large: no group is sorted in one task.

Equal values are counted first.  Different values are dealt to buckets that
keep their order, numbered within a bucket, and shifted by the counts of the
buckets below: two passes instead of one window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Buckets per doubling of a value: a bucket spans 1 / STEPS of the value or less.
STEPS = 4096


def order_bucket(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises: exponent and leading bits of the mantissa."""
    size = F.abs(x)
    exponent = F.floor(F.log2(size))
    place = (exponent + 1100) * STEPS + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * place).cast("long")


def _placed(df: DataFrame, value: str, by: tuple[str, ...], prefix: str, weight: str | None) -> DataFrame:
    """Each different value of a group with its rank: ``(*by, value, {prefix}below, {prefix}ties, {prefix}n)``."""
    amount = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(amount.alias("_count"))
    counts = counts.withColumn("_bucket", order_bucket(F.col("_value").cast("double")))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    under = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy(*by, "_bucket").agg(F.sum("_count").alias("_total"))
    whole = F.sum("_total").over(Window.partitionBy(*by))
    buckets = buckets.select(*by, "_bucket", F.coalesce(F.sum("_total").over(under), F.lit(0)).alias("_low"), whole.alias("_n"))
    placed = counts.withColumn("_inside", F.coalesce(F.sum("_count").over(inside), F.lit(0))).join(buckets, [*by, "_bucket"])
    below = (F.col("_low") + F.col("_inside")).alias(f"{prefix}below")
    return placed.select(*by, F.col("_value").alias(value), below, F.col("_count").alias(f"{prefix}ties"), F.col("_n").alias(f"{prefix}n"))


def ranks(df: DataFrame, value: str, by: tuple[str, ...], prefix: str = "_", weight: str | None = None) -> DataFrame:
    """``df`` with the rank of ``value`` in its group (``{prefix}below``: rows below it; ``{prefix}ties``: rows of equal value; ``{prefix}n``: rows with a value).

    With a ``weight`` these are sums of it.  All three are null where the value
    is.  Groups are told apart by ``by``, which holds no nulls.  The input is
    read three times, so it should be cheap: a table, or cut from its lineage.
    """
    return df.join(_placed(df, value, by, prefix, weight), [*by, value], "left").select(*df.columns, *[prefix + c for c in ("below", "ties", "n")])


def percent_ranks(df: DataFrame, names: dict[str, str], by: str, over_all: bool = False) -> DataFrame:
    """``df`` with each ``name`` the average-tie rank of its value in percent of the group's known values (or of all rows), null where the value is."""
    base = out = cut(df)
    if over_all:
        out = out.join(base.groupBy(by).agg(F.count(F.lit(1)).alias("_all")), by)
    for name, value in names.items():
        out = out.join(_placed(base, value, (by,), "_", None), [by, value], "left")
        total = F.col("_all") if over_all else F.col("_n")
        out = out.withColumn(name, 100 * (F.col("_below") + (F.col("_ties") + 1) / 2) / total).drop("_below", "_ties", "_n")
    return out.select(*df.columns, *names)


def upper_shares(df: DataFrame, value: str, by: tuple[str, ...], name: str) -> DataFrame:
    """``df`` with the share of the group's known values at or above this one."""
    return ranks(cut(df), value, by).withColumn(name, (F.col("_n") - F.col("_below")) / F.col("_n")).drop("_below", "_ties", "_n")


def numbered(df: DataFrame, value: str, by: tuple[str, ...], tie: str, name: str, total: str) -> DataFrame:
    """``df`` with its row number from 1 by ``value`` in the group, equal values in the order of ``tie``, and the group's rows with a value."""
    equal = Window.partitionBy(*by, value).orderBy(tie)
    placed = ranks(cut(df), value, by).withColumn(name, F.when(F.col(value).isNotNull(), F.col("_below") + F.row_number().over(equal)))
    return placed.withColumnRenamed("_n", total).drop("_below", "_ties")


def rank_buckets(place: Column, n: Column, buckets: int) -> Column:
    """Quantile buckets of the row number: bucket 1 holds the least, edges as in interpolated quantiles of 1 .. n."""
    at = buckets * (place - 1) / F.when(n > 1, n - 1).otherwise(F.lit(1))
    return F.greatest(F.lit(1), F.ceil(F.round(at, 9))).cast("int")
