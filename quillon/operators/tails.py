"""Tails of returns: robust moments by quarter, and quantiles of all quarters but one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.lineage import cut
from quillon.functions.ranking import order_bucket

#: A normal spread is this many times the median absolute deviation.
NORMAL_MAD = 1.4826


def robust_moments(df: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: ``n``, ``median``, ``mad_sigma``, and ``skew`` and ``kurtosis`` (excess) without bias, null for groups too small for them."""
    known = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("x"))
    middle = known.groupBy(by).agg(F.median("x").alias("median"))
    apart = known.join(middle, by).groupBy(by).agg(
        F.count("*").alias("n"), F.first("median").alias("median"), (NORMAL_MAD * F.median(F.abs(F.col("x") - F.col("median")))).alias("mad_sigma"),
        F.skewness("x").alias("_s"), F.kurtosis("x").alias("_k"),
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("_s") * F.sqrt(n * (n - 1)) / (n - 2))
    excess = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_k") + 6))
    return apart.select(by, "n", "median", "mad_sigma", skew.alias("skew"), excess.alias("kurtosis"))


def quantiles_without(df: DataFrame, value: str, by: str, q: float) -> DataFrame:
    """``(by, quantile)``: for each group the interpolated quantile of the values of all other groups, null where there are none.

    Values are counted by group and bucket; for each group, prefix sums of the
    other groups' counts over the buckets show in which two the ranks lie, and
    only values of these buckets are counted again.  No group's values are sorted anew with the rest.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(by), F.col(value).cast("double").alias("x"))
    counts = cut(known.groupBy(by, "x").agg(F.count("*").alias("n")).withColumn("bucket", order_bucket(F.col("x"))))
    per_bucket = cut(counts.groupBy("bucket", by).agg(F.sum("n").alias("n")))
    every = per_bucket.groupBy("bucket").agg(F.sum("n").alias("every"))
    groups = per_bucket.groupBy(by).agg(F.sum("n").alias("own"))
    # A row per group and bucket that holds any value: the rest's count there is what all have less the group's own.
    grid = groups.select(by).join(every, how="cross").join(per_bucket, [by, "bucket"], "left")
    grid = grid.withColumn("rest", F.col("every") - F.coalesce("n", F.lit(0)))
    upto = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(by, "bucket", "rest", F.coalesce(F.sum("rest").over(upto), F.lit(0)).alias("below"), F.sum("rest").over(Window.partitionBy(by)).alias("all"))
    at = q * (F.col("all") - 1)
    grid = grid.where("all > 0").withColumns({"lo": F.floor(at), "hi": F.ceil(at), "part": at - F.floor(at)})
    hit = [F.col(k).between(F.col("below"), F.col("below") + F.col("rest") - 1) for k in ("lo", "hi")]
    chosen = grid.where(hit[0] | hit[1])
    rest = chosen.join(counts.select("bucket", F.col(by).alias("_of"), "x", "n"), "bucket").where(~F.col(by).eqNullSafe(F.col("_of")))
    rest = rest.groupBy(by, "bucket", "x", "below", "lo", "hi", "part").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy(by, "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ends = rest.withColumn("upto", F.col("below") + F.sum("n").over(inside))
    value_at = {k: F.min(F.when(F.col("upto") > F.col(k), F.col("x"))) for k in ("lo", "hi")}
    found = ends.groupBy(by).agg(value_at["lo"].alias("a"), value_at["hi"].alias("b"), F.first("part").alias("part"))
    quantile = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return groups.select(by).join(found.select(by, quantile.alias("quantile")), by, "left")
