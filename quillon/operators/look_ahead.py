"""Whether a panel knows what came later: rebuilt from data cut at a quarter, it has to be the same up to there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values differ that are further apart than this, and than this part of the larger: sums of doubles taken in another order part in their last digits.
TOLERANCE, ROUNDING = 1e-9, 1e-12


def compare_panels(full: DataFrame, cut: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``column, rows_full, rows_cut, rows_differ, max_abs_diff``: row ``(rows)`` counts keys that one panel lacks, the others differences in rows of both.

    Values are compared as numbers, up to rounding; one that is known on one side alone differs.  Both panels meet in one join.
    """
    a = full.select(*keys, F.lit(True).alias("_a"), *[F.col(c).cast("double").alias(f"_a{i}") for i, c in enumerate(columns)])
    b = cut.select(*keys, F.lit(True).alias("_b"), *[F.col(c).cast("double").alias(f"_b{i}") for i, c in enumerate(columns)])
    both = a.join(b, keys, "full")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    aggregates = [F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(~shared).alias("n_apart"), F.count_if(shared).alias("n_shared")]
    for i in range(len(columns)):
        x, y = F.col(f"_a{i}"), F.col(f"_b{i}")
        apart = F.abs(x - y)
        differs = (apart > TOLERANCE) & (F.try_divide(apart, F.greatest(F.abs(x), F.abs(y))) > ROUNDING)
        aggregates += [F.count_if(shared & ((x.isNull() != y.isNull()) | differs)).alias(f"d{i}"), F.max(F.when(shared, apart)).alias(f"m{i}")]
    one = both.agg(*aggregates)

    def row(name: str, left: str, right: str, differ: str, most) -> F.Column:
        return F.struct(F.lit(name).alias("column"), F.col(left).alias("rows_full"), F.col(right).alias("rows_cut"), F.col(differ).alias("rows_differ"), most.cast("double").alias("max_abs_diff"))

    rows = [row("(rows)", "n_a", "n_b", "n_apart", F.lit(None)), *[row(c, "n_shared", "n_shared", f"d{i}", F.coalesce(f"m{i}", F.lit(0.0))) for i, c in enumerate(columns)]]
    return one.select(F.inline(F.array(*rows)))


def look_ahead(rows: DataFrame, build: Callable[[DataFrame], DataFrame], cut_q: int, keys: list[str], columns: list[str], closed: int = 0, quarter: str = "qsort") -> DataFrame:
    """``build(rows)`` against ``build`` of the rows up to ``cut_q``, over quarters up to ``cut_q - closed`` (``closed``: how long outcomes stay open)."""
    early = build(rows.where(F.col(quarter) <= cut_q))
    last = cut_q - closed
    return compare_panels(build(rows).where(F.col(quarter) <= last), early.where(F.col(quarter) <= last), keys, columns).withColumn("cut_q", F.lit(cut_q))
