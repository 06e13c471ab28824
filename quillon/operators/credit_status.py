"""Non-accrual status by lender and borrower, entries, status intervals, and drawdowns of chained marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quarters ahead in which an entry is looked for, and quarters a drawdown looks back.
HORIZON, DRAWDOWN_WINDOW = 2, 4


def lender_status(loans: DataFrame, key: str = "borrower") -> DataFrame:
    """``(borrower, qsort, cik, status)``: 1 if the lender flags any loan, 0 if it is known and none is, null if unknown."""
    return loans.groupBy(key, "qsort", "cik").agg(F.max("non_accrual").cast("int").alias("status"), F.sum("FV").alias("fv"))


def borrower_status(lenders: DataFrame, key: str = "borrower") -> DataFrame:
    """Status over a borrower's lenders: flagged by any, lenders that are known, fair value, and whether it was ever flagged so far."""
    per = lenders.groupBy(key, "qsort").agg(
        F.max("status").alias("na_status"), F.count("status").alias("n_lenders_known"), F.sum("fv").alias("fv_debt")
    )
    so_far = Window.partitionBy(key).orderBy("qsort").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("na_ever", F.max(F.coalesce("na_status", F.lit(0))).over(so_far))


def same_lender_entries(lenders: DataFrame, horizon: int = HORIZON, key: str = "borrower") -> DataFrame:
    """``(borrower, qsort)`` where a lender that reports it accruing flags it in one of the next ``horizon`` quarters.

    The flag of the next quarters is looked up in the lender's own window, so no row is shifted and joined.
    """
    ahead = Window.partitionBy(key, "cik").orderBy("qsort").rangeBetween(1, horizon)
    seen = lenders.withColumn("_next", F.max("status").over(ahead))
    return seen.where("status = 0 and _next = 1").select(key, "qsort").distinct()


def status_intervals(events: DataFrame, entity: str, kind: str, at: str, start: str, end: str, tie: str) -> DataFrame:
    """``(entity, start, end)`` of each interval between a ``start`` and an ``end`` event.

    A start that another start follows is overwritten; an end without a start
    has an open left side, a start without an end an open right one.  Other
    kinds are ignored; events at one time are ordered by ``tie``.
    """
    order = Window.partitionBy(entity).orderBy(at, tie)
    marked = events.where(F.col(kind).isin(start, end)).select(
        entity,
        F.col(kind).alias("kind"),
        F.col(at).alias("at"),
        F.lag(kind).over(order).alias("before"),
        F.lag(at).over(order).alias("at_before"),
        F.lead(kind).over(order).alias("after"),
    )
    closed = F.col("kind") == end
    left = F.when(~closed, F.col("at")).when(F.col("before") == start, F.col("at_before"))
    return marked.where(closed | F.col("after").isNull()).select(entity, left.alias("start"), F.when(closed, F.col("at")).alias("end"))


def rolling_max_drawdown(changes: DataFrame, change: str = "d_price", window: int = DRAWDOWN_WINDOW, key: str = "borrower") -> DataFrame:
    """``(borrower, qsort, drawdown)``: the largest fall from a peak of the cumulated changes over the last ``window`` quarters.

    On a dense grid of all quarters; a quarter without a change adds nothing,
    and a window without any has no drawdown.  The bounds of the grid are one row.
    """
    bounds = changes.agg(F.min("qsort").alias("lo"), F.max("qsort").alias("hi"))
    grid = changes.select(key).distinct().join(F.broadcast(bounds)).select(key, "lo", F.explode(F.sequence("lo", "hi")).alias("qsort"))
    order = Window.partitionBy(key).orderBy("qsort")
    dense = grid.join(changes.select(key, "qsort", F.col(change).alias("_change")), [key, "qsort"], "left")
    level = F.sum(F.coalesce("_change", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = F.when(F.col("qsort") > F.col("lo"), F.col("_change"))
    seen = F.count(inside).over(order.rowsBetween(1 - window, 0))
    levels = dense.withColumns({"_level": level, "_seen": seen}).withColumn("_levels", F.collect_list("_level").over(order.rowsBetween(-window, 0)))
    start = F.struct(F.get("_levels", F.lit(0)).alias("peak"), F.lit(0.0).alias("fall"))

    def step(held, x):
        peak = F.greatest(held["peak"], x)
        return F.struct(peak.alias("peak"), F.greatest(held["fall"], peak - x).alias("fall"))

    fall = F.aggregate("_levels", start, step, lambda held: held["fall"])
    return levels.select(key, "qsort", F.when(F.col("_seen") > 0, fall).alias("drawdown"))
