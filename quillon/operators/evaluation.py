"""Evaluation of risk scores: ranks and deciles within a quarter, ROC-AUC, average precision, recall of a review list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.lineage import cut
from quillon.functions.ranking import numbered, ranks


def quarter_ranks(scores: DataFrame, score: str = "pred", quarter: str = "qsort", tie: str = "borrower") -> DataFrame:
    """``scores`` with ``rank``: the place among the quarter's rows as a share, the highest score first; ties by ``tie``."""
    down = numbered(scores.withColumn("_down", -F.col(score)), "_down", (quarter,), tie, "_place", "_rows")
    return down.withColumn("rank", F.col("_place") / F.col("_rows")).drop("_down", "_place", "_rows")


def score_decile(rank: Column, bins: int = 10) -> Column:
    """``bins`` for the riskiest share of a quarter, 1 for the safest."""
    return (F.lit(bins + 1) - F.ceil(F.round(rank * bins, 9))).cast("int")


def decile_table(scores: DataFrame, bins: int = 10, tie: str = "borrower") -> DataFrame:
    """Per decile: rows, events, realised and predicted rate, their ratio, and the share of all events."""
    placed = quarter_ranks(scores, tie=tie).withColumn("decile", score_decile(F.col("rank"), bins))
    table = placed.groupBy("decile").agg(F.count("*").alias("n"), F.sum("y").alias("events"), F.sum("pred").alias("expected"))
    total = F.sum("events").over(Window.partitionBy())  # over ``bins`` rows
    return table.select(
        "decile",
        "n",
        "events",
        (F.col("events") / F.col("n")).alias("event_rate"),
        (F.col("expected") / F.col("n")).alias("predicted_rate"),
        F.try_divide(F.col("events"), F.col("expected")).alias("realized_to_predicted"),
        F.try_divide(F.col("events"), total).alias("share_of_events"),
    )


def recall_at(scores: DataFrame, share: float, tie: str = "borrower") -> DataFrame:
    """Per quarter and over all: the share of events among the riskiest ``share`` of each quarter's rows."""
    placed = quarter_ranks(scores, tie=tie).withColumn("caught", F.when(F.col("rank") <= share, F.col("y")).otherwise(0))
    per = placed.groupBy("qsort").agg(F.sum("caught").alias("caught"), F.sum("y").alias("events"))
    every = per.agg(F.lit(None).cast("int").alias("qsort"), F.sum("caught").alias("caught"), F.sum("events").alias("events"))
    return per.unionByName(every).withColumn("recall", F.try_divide(F.col("caught"), F.col("events")))


def _by_score(scores: DataFrame, by: tuple[str, ...], weight: str | None) -> DataFrame:
    """Weights of events and others at each score: what the curves need, aggregated before anything is ordered."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return cut(scores.groupBy(*by, "pred").agg(F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg")))


def roc_auc(scores: DataFrame, by: tuple[str, ...] = ("qsort",), weight: str | None = None) -> DataFrame:
    """Weighted ROC-AUC per group, ties counting half; null where a group has one class."""
    steps = ranks(_by_score(scores, by, weight), "pred", by, weight="neg")  # summed by score: the ties of a step are its own
    won = F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2))
    return steps.groupBy(*by).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(scores: DataFrame, by: tuple[str, ...] = ("qsort",), weight: str | None = None) -> DataFrame:
    """Weighted average precision per group: precision at each score, by the share of events found there."""
    steps = _by_score(scores, by, weight).withColumns({"_down": -F.col("pred"), "_all": F.col("pos") + F.col("neg")})
    steps = ranks(cut(ranks(steps, "_down", by, "p_", "pos")), "_down", by, "a_", "_all")
    found = F.sum(F.col("pos") * F.try_divide(F.col("p_below") + F.col("pos"), F.col("a_below") + F.col("_all")))
    return steps.groupBy(*by).agg(F.try_divide(found, F.sum("pos")).alias("average_precision"))
