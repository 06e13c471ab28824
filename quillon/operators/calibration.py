"""How well predicted chances fit what happened: recalibration by Newton steps for many weightings at once, weighted deciles, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.lineage import cut
from quillon.functions.ranking import ranks

#: Chances are kept this far from 0 and 1; steps below TOLERANCE end the fit.
LEAST, TOLERANCE, MOST_STEPS = 1e-12, 1e-10, 100


def log_odds(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(LEAST)), F.lit(1 - LEAST))
    return F.log(bounded / (1 - bounded))


def chance(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def apply_recalibration(p: Column, intercept: Column, slope: Column) -> Column:
    return chance(intercept + slope * log_odds(p))


def recalibrations(scores: DataFrame, by: list[str], slope: bool) -> DataFrame:
    """``(*by, intercept, slope)``: the fit of ``y`` on the log odds of ``pred`` with weights ``w``, for every group of ``by`` at once.

    Without ``slope`` it is 1 and the intercept alone is fitted.  Each Newton step
    is one aggregate of the normal equations by group; rows alike in group,
    chance and outcome are summed up before the first.  Groups without both outcomes have no fit (null).
    """
    rows = scores.where("w > 0").groupBy(*by, log_odds(F.col("pred")).alias("x"), F.col("y").cast("double").alias("y")).agg(F.sum("w").alias("w"))
    rows = cut(rows)
    both = F.min("y") < F.max("y")
    start = rows.groupBy(*by).agg(both.alias("both")).select(*by, F.when(F.col("both"), 0.0).alias("intercept"), F.when(F.col("both"), 1.0).alias("slope"))
    fit = cut(start)
    for _ in range(MOST_STEPS):
        mu = chance(F.col("intercept") + F.col("slope") * F.col("x"))
        on = rows.join(fit, by) if by else rows.crossJoin(F.broadcast(fit))  # one row
        terms = on.select(*by, "x", "intercept", "slope", (F.col("w") * mu * (1 - mu)).alias("h"), (F.col("w") * (F.col("y") - mu)).alias("g"))
        sums = terms.groupBy(*by, "intercept", "slope").agg(
            F.sum("h").alias("a"), F.sum(F.col("h") * F.col("x")).alias("b"), F.sum(F.col("h") * F.col("x") * F.col("x")).alias("c"), F.sum("g").alias("d"), F.sum(F.col("g") * F.col("x")).alias("e")
        )
        if slope:
            det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
            one, two = F.try_divide(F.col("c") * F.col("d") - F.col("b") * F.col("e"), det), F.try_divide(F.col("a") * F.col("e") - F.col("b") * F.col("d"), det)
        else:
            one, two = F.try_divide("d", "a"), F.lit(0.0)
        steps = cut(sums.select(*by, (F.col("intercept") + one).alias("intercept"), (F.col("slope") + two).alias("slope"), F.greatest(F.abs(one), F.abs(two)).alias("step")))
        fit = steps.drop("step")
        if steps.where(F.col("step") >= TOLERANCE).isEmpty():
            break
    return fit


def weighted_deciles(scores: DataFrame, by: str = "qsort", tie: str = "borrower", bins: int = 10) -> DataFrame:
    """``scores`` with ``decile`` within the group, 1 the lowest chance: by the share of weight from the highest chance down, equal ones in the order of ``tie``."""
    equal = Window.partitionBy(by, "pred").orderBy(tie).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranks(cut(scores), "pred", (by,), weight="w").withColumn("_upto", F.sum("w").over(equal))
    share = (F.col("_n") - F.col("_below") - F.col("_ties") + F.col("_upto")) / F.col("_n")
    decile = F.lit(bins + 1) - F.ceil(F.round(share * bins, 9))
    return placed.withColumn("decile", decile.cast("int")).drop("_below", "_ties", "_n", "_upto")


def calibration(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per group: observed and expected events, their ratio, the intercept and slope of recalibration, and the mean squared error."""
    used = scores.where("w > 0")
    y, p, w = F.col("y"), F.col("pred"), F.col("w")
    sums = used.groupBy(*by).agg(F.sum(w * y).alias("observed"), F.sum(w * p).alias("expected"), (F.sum(w * (p - y) * (p - y)) / F.sum(w)).alias("brier"))
    a = recalibrations(used, by, False).select(*by, F.col("intercept").alias("cal_intercept"))
    b = recalibrations(used, by, True).select(*by, F.col("slope").alias("cal_slope"))
    out = sums.withColumn("o_e", F.try_divide("observed", "expected"))
    return out.join(a, by, "left").join(b, by, "left")


def decile_gaps(scores: DataFrame, by: str = "qsort", tie: str = "borrower") -> DataFrame:
    """Per decile over all groups: the realized and the predicted chance and their difference."""
    w = F.col("w")
    placed = weighted_deciles(scores.where("w > 0"), by, tie).groupBy("decile").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("realized"), (F.sum(w * F.col("pred")) / F.sum(w)).alias("predicted"))
    return placed.withColumn("gap", F.col("realized") - F.col("predicted"))


def recalibration_sets(frame: DataFrame, train_end: int, test_quarters: list[int], horizon: int) -> dict[str, DataFrame]:
    """The rows to fit on, to recalibrate on and to test on; no outcome that is fitted lies after a later set's first quarter.

    Recalibration takes the last ``horizon`` quarters up to ``train_end``, and its
    own fit the quarters whose outcomes are known before these.
    """
    if train_end + horizon > min(test_quarters):
        raise ValueError("outcomes of the training set are not known by the first test quarter")
    recal_from = train_end - horizon + 1
    return {
        "train": frame.where(F.col("qsort") <= train_end),
        "test": frame.where(F.col("qsort").isin(*test_quarters)),
        "recal_set": frame.where(F.col("qsort").between(recal_from, train_end)),
        "recal_fit": frame.where(F.col("qsort") <= recal_from - horizon),
    }
