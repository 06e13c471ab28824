"""Borrower warning signs, their tails, and what lenders hold of flagged borrowers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.lineage import cut
from quillon.functions.ranking import numbered, rank_buckets, ranks, upper_shares
from quillon.functions.semantics import flag, nz, ratio, sum_or_zero, truthy, weighted_mean

from .crowding import borrower_crowding, family_marks, pik_transitions, tranche_dispersion
from .tranches import NAMELESS

# Limits, lines and groups of the signs.
MOST_MARK = 1.5
TOP_SHARE, PIK_HALF, SWITCH_WINDOW, SIZE_GROUPS, LEAST_BORROWERS = 0.10, 0.5, 4, 5, 20
EXPOSURE_LINE, SINGLE_NAME_LINE = 0.20, 0.05
SIGNS = ("crowding", "disagreement", "pik_half", "pik_switch_q", "pik_switched")
DISTRESS = ("disagreement", "pik_switched")
FULL_HISTORY_FROM = "2024Q1"
CROWDING = {"n_families": "C1_families", "lender_hhi": "C2_lender_hhi", "top_share": "C3_top_share", "d_families_4q": "C4_d_families", "log_par": "log_borrower_par"}


def borrower_name(name: Column) -> Column:
    return F.upper(F.trim(name.cast("string")))


def monitor_panel(tranches: DataFrame, rows: DataFrame) -> DataFrame:
    """Tranche-quarters with in-kind transitions along their chains, dispersion and marks among families, and crowding of their borrower.

    ``tranches`` carries ``chain_id``, ``xb_id`` and ``xb_tier``; ``rows`` are all investments, of which the crowding is counted.
    """
    tranches = cut(tranches)
    out = pik_transitions(tranches, keys=("cik", "chain_id"), percentiles=False).select(*tranches.columns, "pik_share", "is_distress_amendment", "pik_acquired")
    dispersion = cut(tranche_dispersion(tranches, 2, 2, percentiles=False))
    marks = family_marks(tranches, percentiles=False, dispersion=dispersion).select("cal_q", "xb_id", "family", "mark_vs_consensus", "mark_distance")
    dispersion = dispersion.select("cal_q", "xb_id", "V1_std", "V1_range", "V2_low_mark")
    crowd = borrower_crowding(rows, percentiles=False).select("cal_q", "borrower", *[F.col(a).alias(b) for a, b in CROWDING.items()])
    out = out.join(dispersion, ["cal_q", "xb_id"], "left").join(marks, ["cal_q", "xb_id", "family"], "left")
    return out.withColumn("borrower", borrower_name(F.col("borrower_key"))).join(crowd, ["cal_q", "borrower"], "left")


def borrower_quarters(panel: DataFrame, rows: DataFrame) -> DataFrame:
    """Per borrower and quarter of the monitor panel: amounts, mark over priceable rows (up to 1.5), crowding, par-weighted signals, shares of par, and weights in lenders' books."""
    par = F.col("PAR")
    known = F.col("non_accrual").isNotNull()
    first = F.struct("chain_id", "qsort")

    def share(mask: Column) -> Column:
        return F.try_divide(sum_or_zero(F.when(truthy(mask), par)), sum_or_zero(par))

    out = (
        panel.where(~F.col("borrower_key").startswith(NAMELESS))
        .groupBy("borrower", "cal_q")
        .agg(
            F.min("qsort").alias("qsort"),
            F.min_by("sector", F.when(F.col("sector").isNotNull(), first)).alias("sector"),
            *[sum_or_zero(F.col(a)).alias(b) for a, b in (("PAR", "par"), ("FV", "fv"), ("COST", "cost"), ("FV_px", "fv_px"), ("PAR_px", "par_px"))],
            *[F.max(c).alias(c) for c in CROWDING.values()],  # constant within a borrower and quarter
            F.max(F.col("V1_std").isNotNull()).alias("multi_family"),
            *[weighted_mean(F.col(c), par).alias(c) for c in ("V1_std", "V1_range", "V2_low_mark", "mark_distance", "pik_share")],
            share(F.col("pik_share") > 0).alias("pik_par_share"),
            share(F.col("is_distress_amendment")).alias("toggle_par_share"),
            share(F.col("pik_acquired")).alias("acquired_par_share"),
            F.try_divide(F.sum(F.when(known, F.col("COST") * F.col("non_accrual"))), F.sum(F.when(known, F.col("COST")))).alias("na_cost_share"),
        )
    )
    mark = ratio(F.col("fv_px"), F.col("par_px"))
    return out.withColumn("price", F.when(mark <= MOST_MARK, mark)).join(lender_weights(rows), ["borrower", "cal_q"], "left")


def lender_weights(rows: DataFrame) -> DataFrame:
    """Per borrower and quarter: the borrower's share of each lender's book at cost, its largest and its cost-weighted mean.

    A book holds all investments with a cost above 0, rows that name no borrower too.
    """
    held = rows.where("COST > 0").groupBy("cal_q", "cik", borrower_name(F.col("borrower_canonical")).alias("borrower")).agg(F.sum("COST").alias("cost"))
    books = held.groupBy("cal_q", "cik").agg(F.sum("cost").alias("book"))
    shares = held.where("borrower is not null").join(books, ["cal_q", "cik"]).withColumn("weight", F.col("cost") / F.col("book"))
    return shares.groupBy("borrower", "cal_q").agg(
        F.max("weight").alias("max_lender_weight"), weighted_mean(F.col("weight"), F.col("cost")).alias("mean_lender_weight")
    )


def size_groups(panel: DataFrame, size: str = "par", buckets: int = SIZE_GROUPS, tie: str = "borrower") -> DataFrame:
    """Quantile of size within the quarter, 1 the smallest; equal sizes in the order of ``tie``."""
    placed = numbered(panel, size, ("cal_q",), tie, "_place", "_rows")
    return placed.withColumn("size_group", rank_buckets(F.col("_place"), F.col("_rows"), buckets)).drop("_place", "_rows")


def switched_within(toggle: Column, quarters: int, key: str = "borrower") -> Column:
    """1 if ``toggle`` was above 0 in this or one of the ``quarters - 1`` calendar quarters before, else 0; unknown counts as none."""
    w = Window.partitionBy(key).orderBy("qsort").rangeBetween(-(quarters - 1), 0)
    return F.max((nz(toggle) > 0).cast("int")).over(w)


def warning_flags(panel: DataFrame, full_history_from: str = FULL_HISTORY_FROM) -> DataFrame:
    """Signs of each borrower-quarter, 1, 0 or unknown, and ``distress`` (disagreement, or a switch within a year; unknown counts as none).

    crowding: more families than nine in ten borrowers of its size; disagreement:
    a wider range of values than nine in ten shared borrowers; pik_half: over
    half of the coupon in kind; pik_switch_q: a loan switched this quarter
    (unknown in the first one); pik_switched: one did within four quarters
    (unknown before ``full_history_from``).
    """
    out = size_groups(panel)  # materialised where it is ranked, as each of the next is
    out = upper_shares(out, "C1_families", ("cal_q", "size_group"), "crowding_upper_share")
    # Ranked at 12 digits: the order in which a mean was summed does not part equal gaps.
    out = upper_shares(out.withColumn("_gap", F.round("V1_range", 12)), "_gap", ("cal_q",), "disagreement_upper_share").drop("_gap")
    first = out.agg(F.min("cal_q").alias("_first"))
    out = out.crossJoin(F.broadcast(first))  # one row
    signs = {
        "crowding": flag(F.col("crowding_upper_share"), F.col("crowding_upper_share") <= TOP_SHARE),
        "disagreement": flag(F.col("disagreement_upper_share"), F.col("disagreement_upper_share") <= TOP_SHARE),
        "pik_half": flag(F.col("pik_share"), F.col("pik_share") > PIK_HALF),
        "pik_switch_q": F.when(F.col("cal_q") > F.col("_first"), (nz(F.col("toggle_par_share")) > 0).cast("int")),
        "pik_switched": F.when(F.col("cal_q") >= full_history_from, switched_within(F.col("toggle_par_share"), SWITCH_WINDOW)),
    }
    out = out.withColumns(signs)
    return out.withColumn("distress", F.greatest(*[F.coalesce(s, F.lit(0)) for s in DISTRESS])).drop("_first")


def warning_tail(flags: DataFrame, signs: tuple[str, ...] = (*SIGNS, "distress")) -> DataFrame:
    """Per sign and quarter: borrowers measured and flagged, their par, and the flagged shares."""
    long = flags.select("cal_q", "par", F.explode(F.array(*[F.struct(F.lit(s).alias("sign"), F.col(s).alias("on")) for s in signs])).alias("s"))
    long = long.select("cal_q", "par", "s.sign", "s.on").where(F.col("on").isNotNull())
    out = long.groupBy("sign", "cal_q").agg(
        F.count(F.lit(1)).alias("borrowers"), F.sum("on").alias("flagged"), F.sum(F.col("on") * F.col("par")).alias("par_flagged"), F.sum("par").alias("par")
    )
    return out.withColumns({"share": F.col("flagged") / F.col("borrowers"), "par_share": F.try_divide("par_flagged", "par")})


def crowd_bucket(n: Column) -> Column:
    return F.when(n <= 3, n.cast("string")).when(n <= 5, "4-5").otherwise("6+")


def crowding_distribution(panel: DataFrame) -> DataFrame:
    """Per quarter and number of families: borrowers and par, and their shares of the quarter."""
    known = panel.where("C1_families is not null and par > 0").withColumn("bucket", crowd_bucket(F.col("C1_families")))
    parts = known.groupBy("cal_q", "bucket").agg(F.count(F.lit(1)).alias("borrowers"), F.sum("par").alias("par"))
    totals = parts.groupBy("cal_q").agg(F.sum("borrowers").alias("all_borrowers"), F.sum("par").alias("all_par"))
    shares = {"share_borrowers": F.col("borrowers") / F.col("all_borrowers"), "share_par": F.col("par") / F.col("all_par")}
    return parts.join(totals, "cal_q").withColumns(shares)


def weighted_quantiles(rows: DataFrame, x: str, w: str, quantiles: tuple[float, ...], by: str = "cal_q") -> DataFrame:
    """Per group and quantile: the least x at which the running share of weight reaches it; rows without x or weight are left out."""
    known = cut(rows.where(F.col(x).isNotNull() & (F.col(w) > 0)).groupBy(by, x).agg(F.sum(w).alias("w")))
    shares = ranks(known, x, (by,), weight="w").withColumn("share", (F.col("_below") + F.col("w")) / F.col("_n"))
    return shares.groupBy(by).agg(*[F.min(F.when(F.col("share") >= q - 1e-12, F.col(x))).alias(f"p{round(q * 100)}") for q in quantiles])


def disagreement_percentiles(panel: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """Per quarter, over shared borrowers: quantiles of the gap between families' values, by borrowers (interpolated) and by dollars."""
    shared = cut(panel.where("V1_range is not null and par > 0").select("cal_q", "V1_range", "par"))
    plain = shared.groupBy("cal_q").agg(
        F.count(F.lit(1)).alias("borrowers"),
        F.sum("par").alias("par"),
        *[F.percentile("V1_range", F.lit(q)).alias(f"p{round(100 * q)}_borrowers") for q in quantiles],
    )
    dollars = weighted_quantiles(shared, "V1_range", "par", quantiles)
    return plain.join(dollars.select("cal_q", *[F.col(f"p{round(100 * q)}").alias(f"p{round(100 * q)}_dollars") for q in quantiles]), "cal_q")


def lender_exposure(rows: DataFrame, flags: DataFrame, signs: tuple[str, ...] = (*SIGNS, "distress"), least_borrowers: int = LEAST_BORROWERS) -> DataFrame:
    """Per lender and quarter: fair-value weight in borrowers with each sign, the heaviest distressed one, concentration at cost, and the lender's type.

    Weights are of all fair value above 0, that of rows without a borrower's name too.
    """
    positive = rows.where("FV > 0").withColumn("borrower", borrower_name(F.col("borrower_canonical")))
    books = positive.groupBy("cik", "cal_q").agg(F.sum("FV").alias("portfolio_fv"), F.mode("bdc_type", True).alias("bdc_type"))
    held = positive.where("borrower is not null").groupBy("cik", "cal_q", "borrower").agg(F.sum("FV").alias("fv"), F.sum("COST").alias("cost"))
    joined = held.join(books, ["cik", "cal_q"]).join(flags.select("borrower", "cal_q", *signs), ["borrower", "cal_q"], "left")
    weight = F.col("fv") / F.col("portfolio_fv")
    cost = F.when(F.col("cost") > 0, F.col("cost"))
    flagged = F.when(F.col("distress") == 1, F.struct(weight.alias("weight"), F.col("borrower").alias("borrower")))
    out = joined.groupBy("cik", "cal_q").agg(
        F.count(F.lit(1)).alias("n_borrowers"),
        *[F.sum(weight * F.coalesce(s, F.lit(0))).alias(f"exposure_{s}") for s in signs],
        F.max(flagged).alias("_top"),
        (F.sum(cost * cost) / F.pow(F.sum(cost), F.lit(2.0))).alias("concentration"),
        F.max("portfolio_fv").alias("portfolio_fv"),
        F.max("bdc_type").alias("bdc_type"),
    )
    out = out.where(F.col("n_borrowers") >= least_borrowers)
    return out.withColumns(
        {"top_flagged": F.col("_top.borrower"), "top_flagged_weight": F.coalesce(F.col("_top.weight"), F.lit(0.0)), "effective_n": F.try_divide(F.lit(1.0), F.col("concentration"))}
    ).drop("_top")


def exposure_by_quarter(exposure: DataFrame) -> DataFrame:
    """Per quarter: lenders, the median exposure to distressed borrowers, lenders above its line, and those whose heaviest distressed borrower is above its own."""
    over = (F.col("exposure_distress") > EXPOSURE_LINE).cast("int")
    single = (F.col("top_flagged_weight") > SINGLE_NAME_LINE).cast("int")
    return exposure.groupBy("cal_q").agg(
        F.count(F.lit(1)).alias("bdcs"),
        F.percentile("exposure_distress", F.lit(0.5)).alias("median_exposure"),
        F.sum(over).alias("over_line"),
        F.avg(over).alias("share_over_line"),
        F.sum(single).alias("single_name_over"),
        F.avg(single).alias("share_single_name_over"),
    )


def case_studies(panel: DataFrame, rows: DataFrame, borrowers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of some borrowers: their rows of the borrower-quarter panel, and a row per quarter and lender with its mark, weight in the book and in-kind rate."""
    names = [b.strip().upper() for b in borrowers]
    books = rows.where("COST > 0").groupBy("cik", "cal_q").agg(F.sum("COST").alias("_book"))
    own = rows.withColumn("borrower", borrower_name(F.col("borrower_canonical"))).where(F.col("borrower").isin(names))
    lenders = own.groupBy("borrower", "cal_q", "cik", "family", "bdc_type").agg(
        *[sum_or_zero(F.col(c)).alias(c.lower()) for c in ("PAR", "COST", "FV")],
        sum_or_zero(nz(F.col("PIK_Final")) * nz(F.col("PAR"))).alias("_pik"),
        F.max(F.col("non_accrual").cast("double")).alias("non_accrual"),
        F.count(F.lit(1)).alias("positions"),
    )
    lenders = lenders.join(books, ["cik", "cal_q"], "left").withColumns(
        {
            "mark": ratio(F.col("fv"), F.col("par")),
            "pik_rate": ratio(F.col("_pik"), F.col("par")),
            "weight_in_bdc_book": F.col("cost") / F.col("_book"),
        }
    )
    return panel.where(F.col("borrower").isin(names)), lenders.drop("_pik", "_book")


