"""How much is read and kept: values of the nearest quarter for filings that were not read, and par by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.quarters import qsort


def nearest_quarter(rows: DataFrame, known: DataFrame, key: list[str], quarter: str, values: list[str]) -> DataFrame:
    """``rows`` with the ``values`` of ``known`` (a row per key and quarter) in the nearest quarter, the earlier of two as near; null for keys without any.

    Both sides are one table in the order of quarters, where the last known row
    before and the next one after are read by windows: no row meets more than two of its key's.
    """
    held = F.struct(F.col(quarter).alias("_q"), *values)
    left = rows.select(*rows.columns, F.lit(None).cast(known.select(held.alias("h")).schema["h"].dataType).alias("_held"), F.lit(1).alias("_asks"))
    right = known.select(*[F.col(c) if c in (*key, quarter) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], held.alias("_held"), F.lit(0).alias("_asks"))
    order = Window.partitionBy(*key).orderBy(quarter, "_asks")
    before = F.last("_held", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_held", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = left.unionByName(right).withColumns({"_before": before, "_after": after}).where("_asks = 1")
    back, ahead = F.col(quarter) - F.col("_before._q"), F.col("_after._q") - F.col(quarter)
    near = F.when(F.col("_before").isNull() | (ahead < back), F.col("_after")).otherwise(F.col("_before"))
    return out.withColumn("_near", near).select(*rows.columns, *[F.col(f"_near.{v}").alias(v) for v in values])


def par_retention(filings: DataFrame, parsed: DataFrame, final: DataFrame, scale_cap: float = 10.0) -> DataFrame:
    """Par and filings by step: collected (an estimate), read, and kept.

    ``filings``: ``cik, accession, cal_q``; ``parsed``: ``accession, context_id,
    par, fv, unit``; ``final``: ``cik, accession, context_id, cal_q, par``.  Read
    is kept par and that of dropped rows in dollars, at fair value where par is
    over ``scale_cap`` times it.  Filings not read count with the par of the
    lender's nearest quarter; those of lenders without any are counted alone.
    """
    dropped = parsed.join(final.select("accession", "context_id").distinct(), ["accession", "context_id"], "left_anti")
    dropped = dropped.where(F.contains(F.lower(F.coalesce("unit", F.lit(""))), F.lit("usd")) & (F.col("par") > 0))
    wrong = F.coalesce(F.col("par") > scale_cap * F.greatest("fv", F.lit(1.0)), F.lit(False)) & F.col("fv").isNotNull()
    lost = dropped.agg(F.coalesce(F.sum(F.when(wrong, F.col("fv")).otherwise(F.col("par"))), F.lit(0.0)).alias("dropped"), F.count_if(wrong).alias("wrong"))
    unread = filings.select("cik", "accession", qsort(F.col("cal_q")).alias("q")).join(parsed.select("accession").distinct(), "accession", "left_anti")
    known = final.groupBy("cik", qsort(F.col("cal_q")).alias("q")).agg(F.sum("par").alias("est_par"))
    estimated = nearest_quarter(unread, known, ["cik"], "q", ["est_par"])
    missed = estimated.agg(F.coalesce(F.sum("est_par"), F.lit(0.0)).alias("missed"), F.count("*").alias("unread"), F.count_if(F.col("est_par").isNull()).alias("unknown"))
    kept = final.agg(F.coalesce(F.sum("par"), F.lit(0.0)).alias("kept"), F.count_distinct("accession").alias("n_kept"))
    sizes = filings.agg(F.count("*").alias("n_filings")).crossJoin(parsed.agg(F.count_distinct("accession").alias("n_read")))
    one = kept.crossJoin(lost).crossJoin(missed).crossJoin(sizes)  # one row each
    read = F.col("kept") + F.col("dropped")
    step = [("1. Collect (estimated)", "n_filings", read + F.col("missed"), "unknown"), ("2. Read", "n_read", read, "wrong"), ("3. Clean and label", "n_kept", F.col("kept"), None)]
    rows = [
        F.struct(F.lit(s).alias("step"), F.col(n).alias("filings"), par.alias("par_usd"), F.try_divide("kept", par).alias("share_kept"), (F.col(note) if note else F.lit(0).cast("long")).alias("noted"))
        for s, n, par, note in step
    ]
    return one.select(F.inline(F.array(*rows)))
