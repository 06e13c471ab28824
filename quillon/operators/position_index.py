"""Position flows, market weights, the flow-based index and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.semantics import clip, finite, nz, safe_div

POSITION = ("cik", "position_key")
AMOUNTS = ("FV", "COST", "PAR")
RATES = ("PIC_Final", "PIK_Final", "IR_Final", "rate_cash", "interest_rate", "rate_pik")


def final_rates(rows: DataFrame, cash: str = "rate_cash", total: str = "interest_rate", pik: str = "rate_pik") -> DataFrame:
    """Cash, in-kind and total rate of each row with one of the three reported; a single gap follows from the other two."""
    c, t, p = F.col(cash), F.col(total), F.col(pik)
    gaps = sum((x.isNull().cast("int") for x in (c, t, p)), F.lit(0))
    out = rows.withColumn("_gaps", gaps).where("_gaps < 3")
    one = F.col("_gaps") == 1
    return (
        out.withColumns(
            {
                "PIC_Final": F.coalesce(c, F.when(one, t - p), F.when(p.isNull(), t), F.lit(0.0)),
                "PIK_Final": F.coalesce(p, F.when(one, t - c), F.lit(0.0)),
            }
        )
        .withColumn("IR_Final", F.col("PIC_Final") + F.col("PIK_Final"))
        .drop("_gaps")
    )


def add_position_key(rows: DataFrame, borrower: str = "borrower", lien: str = "lien", identifier: str = "investment_identifier") -> DataFrame:
    """``borrower_key`` (the name, or ``ID: `` and the identifier where there is none) and ``position_key`` (with the lien)."""
    name = F.trim(F.col(borrower).cast("string"))
    fallback = F.concat(F.lit("ID: "), F.col(identifier).cast("string")) if identifier in rows.columns else F.lit(None).cast("string")
    out = rows.withColumn("borrower_key", F.when(name != "", name).otherwise(fallback))
    kind = F.coalesce(F.col(lien).cast("string"), F.lit("OTHER_UNKNOWN"))
    return out.withColumn("position_key", F.concat("borrower_key", F.lit(" | "), kind))


def aggregate_positions(rows: DataFrame, keys: tuple[str, ...] = POSITION, quarter: str = "cal_q", ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per position and quarter.

    Amounts are summed (null if all are); rates are weighted by PAR, else by
    absolute FV, else averaged, over the rows that report them; other columns
    come from the row of largest FV, ties broken by ``ties``; ``n_rows`` counts.
    One hash aggregate.
    """
    by = [*keys, quarter]
    amounts = [c for c in AMOUNTS if c in rows.columns]
    rates = [c for c in RATES if c in rows.columns]
    others = [c for c in rows.columns if c not in {*by, *amounts, *rates}]
    par = nz(F.col("PAR")) if "PAR" in rows.columns else F.lit(0.0)

    def weighted(name: str) -> Column:
        x = F.col(name)
        held, worth = F.when(x.isNotNull(), par), F.when(x.isNotNull(), nz(F.abs("FV")))
        return F.coalesce(
            F.when(F.sum(held) > 0, F.sum(x * held) / F.sum(held)),
            F.when(F.sum(worth) > 0, F.sum(x * worth) / F.sum(worth)),
            F.avg(x),
        ).alias(name)

    first = F.struct(F.coalesce("FV", F.lit(float("-inf"))), *[F.col(t) for t in ties])
    picked = [F.max_by(F.struct(*others), first).alias("_of_largest")] if others else []
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in amounts], *[weighted(c) for c in rates], *picked
    )
    return out.select("*", "_of_largest.*").drop("_of_largest") if others else out


def position_flows(aggregated: DataFrame, keys: tuple[str, ...] = POSITION) -> DataFrame:
    """Each position with its previous observation: changes, income at the previous rate and par, and the flow return."""
    w = Window.partitionBy(*keys).orderBy("qsort")
    out = aggregated.withColumns({f"{c}_prev": F.lag(c).over(w) for c in ("FV", "COST", "PAR", "PIC_Final", "PIK_Final")})
    out = out.withColumns(
        {
            "dFV": F.col("FV") - F.col("FV_prev"),
            "dCOST": F.col("COST") - F.col("COST_prev"),
            "cash_income": nz(F.col("PIC_Final_prev")) * nz(F.col("PAR_prev")) / 4,
            "pik_income": nz(F.col("PIK_Final_prev")) * nz(F.col("PAR_prev")) / 4,
        }
    )
    gain = F.col("dFV") - F.col("dCOST") + F.col("cash_income") + F.col("pik_income")
    return out.withColumn("ret_pos_flow", safe_div(gain, F.col("FV_prev")))


def market_weights(flows: DataFrame, quarter: str = "cal_q") -> DataFrame:
    """Valid flows and their weight: previous value over the quarter's total of valid ones.

    Quarter totals are aggregated and joined back (a handful of rows), so no quarter is gathered in one window.
    """
    valid = finite(F.col("ret_pos_flow")) & finite(F.col("FV_prev")) & (F.col("FV_prev") > 0)
    marked = flows.withColumn("is_valid", F.coalesce(valid, F.lit(False)))
    base = F.when(F.col("is_valid"), F.col("FV_prev")).otherwise(F.lit(0.0))
    totals = marked.groupBy(quarter).agg(F.sum(base).alias("FV_prev_sum_q"))
    return marked.join(totals, quarter).withColumn("w_mkt", safe_div(base, F.col("FV_prev_sum_q")))


def return_decomposition(weighted: DataFrame, quarter: str = "cal_q") -> DataFrame:
    """Per quarter: weighted price, cash and in-kind contributions, positions and average rates; empty quarters have zeros."""
    used = F.col("w_mkt") > 0

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(used, x)), F.lit(0.0))

    def share(x: Column) -> Column:
        return total(F.col("w_mkt") * safe_div(x, F.col("FV_prev")))

    return weighted.groupBy(quarter).agg(
        share(F.col("dFV") - F.col("dCOST")).alias("contrib_price"),
        share(F.col("cash_income")).alias("contrib_cash"),
        share(F.col("pik_income")).alias("contrib_pik"),
        F.count(F.when(used, 1)).alias("n_investments"),
        total(F.col("w_mkt") * F.col("PIC_Final")).alias("avg_rate_cash"),
        total(F.col("w_mkt") * F.col("PIK_Final")).alias("avg_rate_pik"),
    )


def market_index(weighted: DataFrame, quarter: str = "cal_q", low: float = -100, high: float = 1000, base: float = 100.0) -> DataFrame:
    """Per quarter: weighted return within bounds and the compounded level; a quarter without links returns 0."""
    by_quarter = weighted.groupBy(quarter).agg(
        F.sum(F.when(F.col("w_mkt") > 0, F.col("w_mkt") * F.col("ret_pos_flow"))).alias("r")
    )
    bounded = clip(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)), low, high)
    upto = Window.orderBy(quarter).rowsBetween(Window.unboundedPreceding, 0)
    return by_quarter.select(quarter, bounded.alias("index_return")).withColumn(
        "index_level", F.lit(base) * F.product(1 + F.col("index_return")).over(upto)
    )


def index_statistics(index: DataFrame, quarter: str = "cal_q", per_year: int = 4, skip: int = 1) -> DataFrame:
    """One row: annual return and volatility, lag-1 autocorrelation, the same unsmoothed, and the largest drawdown.

    The first ``skip`` quarters are left out; the unsmoothing coefficient is the
    autocorrelation within 0 and 0.95.  The index has one row per quarter, so its windows are small.
    """
    w = Window.orderBy(quarter)
    series = index.withColumns(
        {"n": F.row_number().over(w), "peak": F.max("index_level").over(w.rowsBetween(Window.unboundedPreceding, 0))}
    )
    used = series.where(F.col("n") > skip).withColumn("before", F.lag("index_return").over(w))
    auto = used.agg(F.corr("index_return", "before").alias("autocorrelation"))
    theta = F.greatest(F.least(F.coalesce("autocorrelation", F.lit(0.0)), F.lit(0.95)), F.lit(0.0))
    plain = used.crossJoin(F.broadcast(auto.withColumn("theta", theta)))  # one row beside each quarter
    free = (F.col("index_return") - F.col("theta") * F.col("before")) / (1 - F.col("theta"))

    def annual(r: Column) -> Column:
        return F.pow(F.product(1 + r), F.lit(float(per_year)) / F.count(r)) - 1

    return plain.withColumn("free", free).agg(
        annual(F.col("index_return")).alias("annual_return"),
        (F.stddev_samp("index_return") * F.sqrt(F.lit(float(per_year)))).alias("annual_volatility"),
        F.max("autocorrelation").alias("autocorrelation"),
        annual(F.col("free")).alias("unsmoothed_return"),
        (F.stddev_samp("free") * F.sqrt(F.lit(float(per_year)))).alias("unsmoothed_volatility"),
        F.min((F.col("index_level") - F.col("peak")) / F.col("peak")).alias("max_drawdown"),
        F.count(F.lit(1)).alias("n_quarters"),
    )


def benchmark_statistics(index: DataFrame, benchmark: DataFrame, quarter: str = "cal_q", per_year: int = 4) -> DataFrame:
    """One row: correlation, annual tracking error and mean gap of two return series (``index_return``, ``benchmark_return``)."""
    both = index.join(benchmark, quarter).withColumn("gap", F.col("index_return") - F.col("benchmark_return"))
    return both.agg(
        F.corr("index_return", "benchmark_return").alias("correlation"),
        (F.stddev_samp("gap") * F.sqrt(F.lit(float(per_year)))).alias("tracking_error"),
        F.avg("gap").alias("mean_gap"),
        F.count(F.lit(1)).alias("n_quarters"),
    )


def calendar_year_returns(index: DataFrame, quarter: str = "cal_q") -> DataFrame:
    """Compounded return of each calendar year and the quarters in it."""
    return index.groupBy(F.substring(quarter, 1, 4).cast("int").alias("year")).agg(
        (F.product(1 + F.col("index_return")) - 1).alias("year_return"), F.count(F.lit(1)).alias("n_quarters")
    )
