"""Lender crowding, valuation dispersion between families, and payment-in-kind transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.lineage import cut
from quillon.functions.quarters import qsort
from quillon.functions.ranking import percent_ranks
from quillon.functions.semantics import clip, nz, safe_div, truthy

#: In-kind rates below this count as none; a rise of the in-kind share by this much is a toggle.
LEAST_PIK, LEAST_RISE = 0.0025, 0.10
MOST_PRICE = 1.2


def borrower_crowding(rows: DataFrame, borrower: str = "borrower", lag_quarters: int = 4, percentiles: bool = True) -> DataFrame:
    """Per quarter and borrower: families, lenders, par concentration, change of families over a year, percentiles.

    Two aggregates (family, then borrower) replace a window over rows.  A
    borrower absent a year ago counts as 0 families; before the panel's start the change is null.
    """
    base = rows.where("PAR > 0 AND FV > 0").withColumn("borrower", F.upper(F.trim(F.col(borrower).cast("string")))).where("borrower <> ''")
    by_family = base.groupBy("cal_q", "borrower", "family").agg(F.sum("PAR").alias("par"), F.countDistinct("cik").alias("ciks"))
    out = by_family.groupBy("cal_q", "borrower").agg(
        F.count(F.lit(1)).alias("n_families"),
        F.sum("ciks").alias("n_ciks"),
        (F.sum(F.col("par") * F.col("par")) / F.pow(F.sum("par"), F.lit(2))).alias("lender_hhi"),
        (F.max("par") / F.sum("par")).alias("top_share"),
        F.sum("par").alias("total_par"),
    )
    out = cut(out.withColumns({"log_par": F.ln("total_par"), "q": qsort(F.col("cal_q"))}))  # a row per borrower and quarter, read three times
    start = out.agg(F.min("q").alias("first_q"))
    before = out.select("borrower", (F.col("q") + lag_quarters).alias("q"), F.col("n_families").alias("n_before"))
    out = out.join(before, ["borrower", "q"], "left").crossJoin(F.broadcast(start))  # one row
    change = F.when(F.col("q") - lag_quarters >= F.col("first_q"), F.col("n_families") - F.coalesce("n_before", F.lit(0)))
    out = out.withColumn("d_families_4q", change).drop("n_before", "first_q")
    ranked = {"C1_pct": "n_families", "C2_pct": "lender_hhi", "C3_pct": "top_share", "C4_pct": "d_families_4q"}
    return percent_ranks(out.drop("q"), ranked, "cal_q") if percentiles else out.drop("q")


def family_prices(tranches: DataFrame, most_price: float = MOST_PRICE, least_families: int = 1) -> DataFrame:
    """One price per quarter, loan (``xb_id``) and family, over priceable rows; dear ones and loans of too few families are left out.

    ``tier`` is the worst match of the family's rows, ``unplaced`` whether one of them has none.
    """
    if "PAR_px" in tranches.columns:
        tranches = tranches.where("PAR_px > 0").withColumns({"FV": F.col("FV_px"), "PAR": F.col("PAR_px")})
    if least_families > 1:
        several = tranches.groupBy("xb_id").agg(F.countDistinct("family").alias("n")).where(F.col("n") >= least_families)
        tranches = tranches.join(several.select("xb_id"), "xb_id", "left_semi")
    out = tranches.groupBy("cal_q", "xb_id", "family").agg(
        F.sum("FV").alias("FV"), F.sum("PAR").alias("PAR"), F.max("xb_tier").alias("tier"), F.max(F.col("xb_tier").isNull()).alias("unplaced"), F.countDistinct("cik").alias("n_bdcs")
    )
    return out.withColumn("price", F.try_divide("FV", "PAR")).where(F.col("price") <= most_price)


def tranche_dispersion(tranches: DataFrame, least_families: int = 2, most_tier: int = 3, most_price: float = MOST_PRICE, percentiles: bool = True) -> DataFrame:
    """Per quarter and loan held by several families: consensus (median), spread of prices, low mark, percentiles."""
    prices = family_prices(tranches, most_price, least_families)
    out = prices.groupBy("cal_q", "xb_id").agg(
        F.count(F.lit(1)).alias("n_families"),
        F.sum("n_bdcs").alias("n_bdcs"),
        F.sum("PAR").alias("total_par"),
        F.max("tier").alias("tier"),
        F.max("unplaced").alias("unplaced"),
        F.percentile("price", F.lit(0.5)).alias("V4_consensus"),
        F.stddev_samp("price").alias("V1_std"),
        (F.percentile("price", F.lit(0.75)) - F.percentile("price", F.lit(0.25))).alias("V1_iqr"),
        F.min("price").alias("p_min"),
        F.max("price").alias("p_max"),
    )
    out = out.where((F.col("n_families") >= least_families) & ~F.col("unplaced") & (F.col("tier") <= most_tier)).drop("unplaced")
    out = out.withColumns({"V1_range": F.col("p_max") - F.col("p_min"), "V2_low_mark": F.col("p_min") - F.col("V4_consensus")})
    return percent_ranks(out, {"V1_pct": "V1_std", "V2_pct": "V2_low_mark", "V4_pct": "V4_consensus"}, "cal_q") if percentiles else out


def family_marks(tranches: DataFrame, least_families: int = 2, most_tier: int = 2, percentiles: bool = True, dispersion: DataFrame | None = None) -> DataFrame:
    """Each family's price less the consensus of its co-lenders, its distance and the distance's percentile."""
    dispersion = tranche_dispersion(tranches, least_families, most_tier, percentiles=False) if dispersion is None else dispersion
    consensus = dispersion.select("cal_q", "xb_id", "V4_consensus")
    out = family_prices(tranches, least_families=least_families).join(consensus, ["cal_q", "xb_id"])
    out = out.withColumn("mark_vs_consensus", F.col("price") - F.col("V4_consensus"))
    out = out.withColumn("mark_distance", F.abs("mark_vs_consensus"))
    return percent_ranks(out, {"distance_pct": "mark_distance"}, "cal_q") if percentiles else out


def pik_transitions(
    loans: DataFrame,
    keys: tuple[str, ...] = ("cik", "tranche_id"),
    least_pik: float = LEAST_PIK,
    least_rise: float = LEAST_RISE,
    origination: str = "pik_at_origination",
    percentiles: bool = True,
) -> DataFrame:
    """Along each loan: in-kind share, its state against the previous observation, toggles, and whether in-kind pay was acquired."""
    w = Window.partitionBy(*keys).orderBy("qsort")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = loans.withColumn("qsort", qsort(F.col("cal_q")))
    out = out.withColumn("pik_share", clip(safe_div(nz(F.col("PIK_Final")), F.col("IR_Final")), 0.0, 1.0))
    out = out.withColumns(
        {
            "q_incept": F.first("cal_q").over(upto),
            "PAR_incept": F.first("PAR").over(upto),
            "PIK_prev": F.lag("PIK_Final").over(w),
            "PAR_prev": F.lag("PAR").over(w),
            "pik_share_prev": F.lag("pik_share").over(w),
        }
    )
    starts = F.col("cal_q") == F.col("q_incept")
    now, before = nz(F.col("PIK_Final")) >= least_pik, nz(F.col("PIK_prev")) >= least_pik
    risen = F.col("pik_share") - nz(F.col("pik_share_prev")) >= least_rise
    cash_first = truthy(~F.col(origination)) if origination in loans.columns else F.lit(False)
    toggled = ~starts & now & (~before | truthy(risen))
    state = (
        F.when(starts & now & cash_first, "acquired_pik")
        .when(starts & now, "contractual_pik")
        .when(starts, "stable_cash")
        .when(toggled, "distress_amendment_pik")
        .when(before & ~now, "cured_pik")
        .when(~now, "stable_cash")
        .otherwise("seasoned_pik_continuation")
    )
    out = out.withColumns(
        {"delta_pik": nz(F.col("PIK_Final")) - nz(F.col("PIK_prev")), "pik_transition_state": state, "is_distress_amendment": toggled}
    )
    out = out.withColumn("pik_acquired", now & (cash_first | F.max("is_distress_amendment").over(upto)))
    return percent_ranks(out, {"P1_pct": "pik_share"}, "cal_q", over_all=True) if percentiles else out
