"""The engine's queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import quarters
from quillon.functions.lineage import cut, kept
from quillon.operators import credit_events as events
from quillon.operators import credit_status as credit
from quillon.operators import calibration, crowding, evaluation, exposure, features, look_ahead, model, rates, tails, tranches
from quillon.operators import position_index as index
from quillon.functions.semantics import weighted_mean

from . import filings, repairs  # noqa: F401  they register their queries
from .proxy import POSITIONS_SQL, positions, table
from .registry import ORACLE_SQL, QUERIES, query, rounded

#: Greedy matching and an iterative fit have no SQL form; their tests compare them with cases and computations by hand.
WITHOUT_SQL = ("tranche_panel", "logit_coefficients")
FLAGSHIP = "position_index"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.add_position_key(index.final_rates(positions(spark, sf_dir)))


_KEEP = ("cik", "position_key", "cal_q", "qsort", "borrower", "family", "lien", "FV", "COST", "PAR", "PIC_Final", "PIK_Final", "IR_Final")


def _aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a lender in one borrower and lien; ``qsort`` and ``family`` are constant within the key."""
    rows = _rated(spark, sf_dir).select(*_KEEP)
    return index.aggregate_positions(rows, keys=("cik", "position_key"), ties=("borrower",))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.market_weights(index.position_flows(_aggregated(spark, sf_dir)))


AGGREGATED_SQL = POSITIONS_SQL + """,
agg AS (
  SELECT cik, borrower || ' | ' || lien AS position_key, cal_q, max(qsort) AS qsort, max(borrower) AS borrower, max(family) AS family, max(lien) AS lien,
    sum(FV) AS FV, sum(COST) AS COST, sum(PAR) AS PAR, CAST(count(*) AS BIGINT) AS n_rows,
    sum(PIC_Final * PAR) / sum(PAR) AS PIC_Final, sum(PIK_Final * PAR) / sum(PAR) AS PIK_Final, sum(IR_Final * PAR) / sum(PAR) AS IR_Final
  FROM final GROUP BY cik, borrower, lien, cal_q
),
lagged AS (
  SELECT *, lag(FV) OVER w AS FV_prev, lag(COST) OVER w AS COST_prev, lag(PAR) OVER w AS PAR_prev,
    lag(PIC_Final) OVER w AS PIC_Final_prev, lag(PIK_Final) OVER w AS PIK_Final_prev
  FROM agg WINDOW w AS (PARTITION BY cik, position_key ORDER BY qsort)
),
flows AS (
  SELECT *, FV - FV_prev AS dFV, COST - COST_prev AS dCOST,
    coalesce(PIC_Final_prev, 0) * coalesce(PAR_prev, 0) / 4 AS cash_income, coalesce(PIK_Final_prev, 0) * coalesce(PAR_prev, 0) / 4 AS pik_income
  FROM lagged
),
returns AS (
  SELECT *, CASE WHEN FV_prev IS NULL OR FV_prev = 0 THEN 0 ELSE (dFV - dCOST + cash_income + pik_income) / FV_prev END AS ret_pos_flow FROM flows
),
weighted AS (
  SELECT *, CASE WHEN tot IS NULL OR tot = 0 THEN 0 ELSE base / tot END AS w_mkt FROM (
    SELECT *, CASE WHEN FV_prev > 0 THEN FV_prev ELSE 0 END AS base, sum(CASE WHEN FV_prev > 0 THEN FV_prev ELSE 0 END) OVER (PARTITION BY cal_q) AS tot
    FROM returns)
),
idx AS (
  SELECT cal_q, coalesce(sum(CASE WHEN w_mkt > 0 THEN w_mkt * ret_pos_flow END), 0) AS index_return FROM weighted GROUP BY cal_q
),
levels AS (
  SELECT cal_q, index_return, 100 * exp(sum(ln(1 + index_return)) OVER (ORDER BY cal_q)) AS index_level FROM idx
)"""


@query(f"""WITH {AGGREGATED_SQL}
SELECT cal_q, round(index_return, 6) AS index_return, round(index_level, 6) AS index_level FROM levels""")
def position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index.market_index(_weighted(spark, sf_dir)))


@query(f"""WITH {AGGREGATED_SQL}
SELECT cik, position_key, cal_q, n_rows, round(FV, 4) AS FV, round(PIC_Final, 6) AS PIC_Final, round(dFV, 4) AS dFV, round(cash_income, 6) AS cash_income,
  round(ret_pos_flow, 6) AS ret_pos_flow FROM returns""")
def position_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = index.position_flows(_aggregated(spark, sf_dir))
    return flows.select(
        "cik",
        "position_key",
        "cal_q",
        "n_rows",
        F.round("FV", 4).alias("FV"),
        F.round("PIC_Final", 6).alias("PIC_Final"),
        F.round("dFV", 4).alias("dFV"),
        F.round("cash_income", 6).alias("cash_income"),
        F.round("ret_pos_flow", 6).alias("ret_pos_flow"),
    )


@query(f"""WITH {POSITIONS_SQL}
SELECT row_a, row_b, cal_q, round(PIC_Final, 6) AS PIC_Final, round(PIK_Final, 6) AS PIK_Final, round(IR_Final, 6) AS IR_Final FROM final""")
def final_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index.final_rates(positions(spark, sf_dir)).select("row_a", "row_b", "cal_q", "PIC_Final", "PIK_Final", "IR_Final"))


@query(f"""WITH {AGGREGATED_SQL}
SELECT cal_q,
  round(coalesce(sum(CASE WHEN w_mkt > 0 THEN w_mkt * (dFV - dCOST) / FV_prev END), 0), 6) AS contrib_price,
  round(coalesce(sum(CASE WHEN w_mkt > 0 THEN w_mkt * cash_income / FV_prev END), 0), 6) AS contrib_cash,
  round(coalesce(sum(CASE WHEN w_mkt > 0 THEN w_mkt * pik_income / FV_prev END), 0), 6) AS contrib_pik,
  CAST(count(CASE WHEN w_mkt > 0 THEN 1 END) AS BIGINT) AS n_investments,
  round(coalesce(sum(CASE WHEN w_mkt > 0 THEN w_mkt * PIC_Final END), 0), 6) AS avg_rate_cash,
  round(coalesce(sum(CASE WHEN w_mkt > 0 THEN w_mkt * PIK_Final END), 0), 6) AS avg_rate_pik
FROM weighted GROUP BY cal_q""")
def return_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index.return_decomposition(_weighted(spark, sf_dir)))


@query(f"""WITH {AGGREGATED_SQL},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY cal_q) AS n, max(index_level) OVER (ORDER BY cal_q) AS peak, lag(index_return) OVER (ORDER BY cal_q) AS b FROM levels
),
used AS (SELECT *, CASE WHEN n > 2 THEN b END AS before FROM numbered WHERE n > 1),
th AS (SELECT corr(index_return, before) AS autocorrelation, greatest(least(coalesce(corr(index_return, before), 0), 0.95), 0) AS theta FROM used),
f AS (SELECT *, (index_return - theta * before) / (1 - theta) AS free FROM used, th)
SELECT round(exp(sum(ln(1 + index_return)) * 4.0 / count(*)) - 1, 6) AS annual_return, round(stddev_samp(index_return) * 2, 6) AS annual_volatility,
  round(max(autocorrelation), 6) AS autocorrelation, round(exp(sum(ln(1 + free)) * 4.0 / count(free)) - 1, 6) AS unsmoothed_return,
  round(stddev_samp(free) * 2, 6) AS unsmoothed_volatility, round(min((index_level - peak) / peak), 6) AS max_drawdown, CAST(count(*) AS BIGINT) AS n_quarters
FROM f""")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index.index_statistics(index.market_index(_weighted(spark, sf_dir))))


@query(f"""WITH {AGGREGATED_SQL}
SELECT CAST(substr(cal_q, 1, 4) AS INT) AS year, round(exp(sum(ln(1 + index_return))) - 1, 6) AS year_return, CAST(count(*) AS BIGINT) AS n_quarters
FROM levels GROUP BY 1""")
def calendar_year_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index.calendar_year_returns(index.market_index(_weighted(spark, sf_dir))))


def _senior(weighted: DataFrame) -> DataFrame:
    """The index over one lien alone, weighed anew."""
    flows = weighted.drop("w_mkt", "FV_prev_sum_q", "is_valid").where(F.col("lien").startswith("STANDARD"))
    return index.market_index(index.market_weights(flows))


@query(f"""WITH {AGGREGATED_SQL},
sen AS (SELECT *, CASE WHEN FV_prev > 0 THEN FV_prev ELSE 0 END AS base FROM returns WHERE lien LIKE 'STANDARD%'),
sidx AS (SELECT cal_q, coalesce(sum(base * ret_pos_flow) / nullif(sum(base), 0), 0) AS r FROM sen GROUP BY cal_q),
both_ AS (SELECT i.cal_q, index_return, r, r - index_return AS gap FROM sidx JOIN idx i ON i.cal_q = sidx.cal_q)
SELECT round(corr(r, index_return), 6) AS correlation, round(stddev_samp(gap) * 2, 6) AS tracking_error, round(avg(gap), 6) AS mean_gap, CAST(count(*) AS BIGINT) AS n_quarters
FROM both_""")
def senior_against_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = _weighted(spark, sf_dir)
    market = index.market_index(weighted).select("cal_q", F.col("index_return").alias("benchmark_return"))
    return rounded(index.benchmark_statistics(_senior(weighted), market))


def pct_sql(column: str, group: str = "cal_q", total: str | None = None) -> str:
    """Average-tie percent rank in SQL."""
    return (
        f"CASE WHEN {column} IS NOT NULL THEN (rank() OVER (PARTITION BY {group}, {column} IS NULL ORDER BY {column})"
        f" + (count(*) OVER (PARTITION BY {group}, {column}) - 1) / 2.0) / {total or f'count({column}) OVER (PARTITION BY {group})'} END"
    )


@query(f"""WITH {POSITIONS_SQL},
fam AS (SELECT cal_q, upper(trim(borrower)) AS borrower, family, sum(PAR) AS par, count(DISTINCT cik) AS ciks FROM pos WHERE PAR > 0 AND FV > 0 GROUP BY ALL),
b AS (
  SELECT cal_q, borrower, CAST(count(*) AS BIGINT) AS n_families, CAST(sum(ciks) AS BIGINT) AS n_ciks, sum(par * par) / (sum(par) * sum(par)) AS lender_hhi,
    max(par) / sum(par) AS top_share, sum(par) AS total_par, CAST(substr(cal_q, 1, 4) AS INT) * 4 + CAST(substr(cal_q, 6, 1) AS INT) AS q
  FROM fam GROUP BY cal_q, borrower
),
d AS (
  SELECT b.*, CASE WHEN b.q - 4 >= (SELECT min(q) FROM b) THEN b.n_families - coalesce(o.n_families, 0) END AS d_families_4q
  FROM b LEFT JOIN b o ON o.borrower = b.borrower AND o.q = b.q - 4
)
SELECT cal_q, borrower, n_families, n_ciks, round(lender_hhi, 6) AS lender_hhi, round(top_share, 6) AS top_share, d_families_4q,
  round(100 * {pct_sql("n_families")}, 4) AS C1_pct, round(100 * {pct_sql("lender_hhi")}, 4) AS C2_pct, round(100 * {pct_sql("top_share")}, 4) AS C3_pct,
  round(100 * {pct_sql("d_families_4q")}, 4) AS C4_pct FROM d""")
def crowding_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crowding.borrower_crowding(positions(spark, sf_dir))
    return found.select(
        "cal_q",
        "borrower",
        "n_families",
        "n_ciks",
        F.round("lender_hhi", 6).alias("lender_hhi"),
        F.round("top_share", 6).alias("top_share"),
        "d_families_4q",
        *[F.round(c, 4).alias(c) for c in ("C1_pct", "C2_pct", "C3_pct", "C4_pct")],
    )


def _percent_sql(column: str, total: str | None = None) -> str:
    """The average-tie rank of a known value in percent of its quarter's known values, or of all its rows."""
    total = total or f"count({column}) OVER (PARTITION BY cal_q)"
    rank = f"rank() OVER (PARTITION BY cal_q ORDER BY {column} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY cal_q, {column}) + 1) / 2"
    return f"CASE WHEN {column} IS NOT NULL THEN round(100 * ({rank}) / {total}, 4) END"


def _tranches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir)
    return rows.select("cal_q", F.concat_ws("|", "cal_q", "borrower", "lien").alias("xb_id"), "family", "cik", "FV", "PAR", F.lit(1).alias("xb_tier"))


_DISPERSION_SQL = f"""{POSITIONS_SQL},
tr AS (SELECT cal_q, cal_q || '|' || borrower || '|' || lien AS xb_id, family, cik, FV, PAR FROM pos),
many AS (SELECT xb_id FROM tr GROUP BY xb_id HAVING count(DISTINCT family) >= 2),
fam AS (
  SELECT * FROM (SELECT cal_q, xb_id, family, sum(FV) / sum(PAR) AS price, sum(PAR) AS PAR, count(DISTINCT cik) AS n_bdcs FROM tr
    WHERE xb_id IN (SELECT xb_id FROM many) GROUP BY ALL) WHERE price <= 1.2
),
disp AS (
  SELECT cal_q, xb_id, CAST(count(*) AS BIGINT) AS n_families, CAST(sum(n_bdcs) AS BIGINT) AS n_bdcs, quantile_cont(price, 0.5) AS V4_consensus,
    stddev_samp(price) AS V1_std, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS V1_iqr, min(price) AS p_min, max(price) AS p_max
  FROM fam GROUP BY cal_q, xb_id HAVING count(*) >= 2
)"""


@query(f"""WITH {_DISPERSION_SQL}
SELECT cal_q, xb_id, n_families, n_bdcs, round(V4_consensus, 6) AS V4_consensus, round(V1_std, 6) AS V1_std, round(V1_iqr, 6) AS V1_iqr,
  round(p_max - p_min, 6) AS V1_range, round(p_min - V4_consensus, 6) AS V2_low_mark FROM disp""")
def family_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crowding.tranche_dispersion(_tranches(spark, sf_dir))
    return rounded(found.select("cal_q", "xb_id", "n_families", "n_bdcs", "V4_consensus", "V1_std", "V1_iqr", "V1_range", "V2_low_mark"))


@query(f"""WITH {_DISPERSION_SQL}
SELECT f.cal_q, f.xb_id, f.family, round(price, 6) AS price, round(price - V4_consensus, 6) AS mark_vs_consensus, round(abs(price - V4_consensus), 6) AS mark_distance
FROM fam f JOIN disp d ON d.xb_id = f.xb_id""")
def family_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crowding.family_marks(_tranches(spark, sf_dir))
    return rounded(found.select("cal_q", "xb_id", "family", "price", "mark_vs_consensus", "mark_distance"))


@query(f"""WITH {AGGREGATED_SQL},
s AS (
  SELECT cik, position_key, cal_q, qsort, PIK_Final, CASE WHEN IR_Final IS NULL OR IR_Final = 0 THEN 0 ELSE least(greatest(coalesce(PIK_Final, 0) / IR_Final, 0), 1) END AS pik_share
  FROM agg
),
l AS (
  SELECT *, first_value(cal_q) OVER w AS q_incept, lag(PIK_Final) OVER w AS PIK_prev, lag(pik_share) OVER w AS share_prev FROM s
  WINDOW w AS (PARTITION BY cik, position_key ORDER BY qsort)
),
k AS (
  SELECT *, coalesce(PIK_Final, 0) >= 0.0025 AS now_, coalesce(PIK_prev, 0) >= 0.0025 AS before_, cal_q = q_incept AS starts,
    coalesce(pik_share - coalesce(share_prev, 0) >= 0.10, false) AS risen FROM l
),
t AS (SELECT *, (NOT starts AND now_ AND (NOT before_ OR risen)) AS is_distress_amendment FROM k)
SELECT cik, position_key, cal_q, round(pik_share, 6) AS pik_share,
  CASE WHEN starts AND now_ THEN 'contractual_pik' WHEN starts THEN 'stable_cash' WHEN is_distress_amendment THEN 'distress_amendment_pik'
    WHEN before_ AND NOT now_ THEN 'cured_pik' WHEN NOT now_ THEN 'stable_cash' ELSE 'seasoned_pik_continuation' END AS pik_transition_state,
  is_distress_amendment, (now_ AND max(is_distress_amendment) OVER (PARTITION BY cik, position_key ORDER BY qsort)) AS pik_acquired,
  round(coalesce(PIK_Final, 0) - coalesce(PIK_prev, 0), 6) AS delta_pik, {_percent_sql("pik_share", "count(*) OVER (PARTITION BY cal_q)")} AS P1_pct
FROM t""")
def pik_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crowding.pik_transitions(_aggregated(spark, sf_dir), keys=("cik", "position_key"))
    return rounded(found.select("cik", "position_key", "cal_q", "pik_share", "pik_transition_state", "is_distress_amendment", "pik_acquired", "delta_pik", F.round("P1_pct", 4).alias("P1_pct")))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All investments; a borrower is a brand and the first word of a type, an unnamed one in the smallest brand.

    What many queries build on (these rows, the panels, loans and exits) is made once a session and folder.
    """
    return kept(spark, ("rows", sf_dir), lambda: _all_rows(spark, sf_dir))


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.final_rates(positions(spark, sf_dir))
    name = F.concat_ws(" ", "borrower", F.substring_index("lien", " ", 1))
    rows = rows.withColumn("borrower_canonical", F.when(F.col("borrower") != "Brand#11", name)).withColumns(
        {"sector": F.substring_index("lien", " ", -1), "borrower": exposure.borrower_name(F.col("borrower_canonical"))}
    )
    return rows.drop("rate_cash", "rate_pik", "interest_rate")


def _loans(rows: DataFrame) -> DataFrame:
    """Tranche-quarters with plain ids: a chain is a borrower at a lender, a loan across lenders a borrower in a quarter."""
    named = rows.where("borrower is not null")
    par = F.col("PAR")
    out = named.groupBy("cik", "family", "borrower", "cal_q", "qsort").agg(
        *[F.sum(c).alias(c) for c in ("FV", "COST", "PAR")],
        *[F.sum(F.when(F.col("price_ok"), F.col(c)).otherwise(0.0)).alias(f"{c}_px") for c in ("FV", "PAR")],
        *[weighted_mean(F.col(c), par).alias(c) for c in ("PIK_Final", "IR_Final")],
        *[F.max(c).alias(c) for c in ("non_accrual", "sector", "maturity", "spread")],
    )
    ids = {"chain_id": F.concat_ws("|", "cik", "borrower"), "xb_id": F.concat_ws("|", "cal_q", "borrower"), "xb_tier": F.lit(1), "borrower_key": F.col("borrower")}
    out = out.withColumns(ids).drop("borrower")
    linked = F.lag("qsort").over(Window.partitionBy("chain_id").orderBy("qsort")).isNotNull()
    price = F.when(F.col("PAR_px") > 0, F.col("FV_px") / F.col("PAR_px"))
    return out.withColumns({"lien_group": F.lit("1L"), "link_rule": linked.cast("int"), "price": price})


def _monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return kept(spark, ("monitor", sf_dir), lambda: exposure.monitor_panel(_loans(rows), rows))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, ("panel", sf_dir), lambda: exposure.borrower_quarters(_monitor(spark, sf_dir), _rows(spark, sf_dir)))


HISTORY_FROM = "1993Q2"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, ("flags", sf_dir), lambda: exposure.warning_flags(_panel(spark, sf_dir), HISTORY_FROM))


def _upper_sql(column: str, group: str) -> str:
    return (
        f"CASE WHEN {column} IS NOT NULL THEN (count({column}) OVER (PARTITION BY {group}) - rank() OVER (PARTITION BY {group}, {column} IS NULL ORDER BY {column}) + 1)"
        f" / count({column}) OVER (PARTITION BY {group}) END"
    )


def _mean_sql(column: str, weight: str = "PAR") -> str:
    used = f"FILTER (WHERE {column} IS NOT NULL AND {weight} > 0)"
    return f"sum({column} * {weight}) {used} / sum({weight}) {used}"


MONITOR_SQL = f"""{POSITIONS_SQL},
rows_ AS (
  SELECT * EXCLUDE (borrower), CASE WHEN borrower <> 'Brand#11' THEN upper(borrower || ' ' || split_part(lien, ' ', 1)) END AS borrower,
    list_last(string_split(lien, ' ')) AS sector FROM final
),
tr AS (
  SELECT cik, family, borrower, cal_q, qsort, sum(FV) AS FV, sum(COST) AS COST, sum(PAR) AS PAR, sum(CASE WHEN price_ok THEN FV ELSE 0 END) AS FV_px,
    sum(CASE WHEN price_ok THEN PAR ELSE 0 END) AS PAR_px, sum(PIK_Final * PAR) / sum(PAR) AS PIK_Final, sum(IR_Final * PAR) / sum(PAR) AS IR_Final,
    max(non_accrual) AS non_accrual, max(sector) AS sector, max(maturity) AS maturity, max(spread) AS spread
  FROM rows_ WHERE borrower IS NOT NULL GROUP BY ALL
),
s0 AS (SELECT *, CASE WHEN IR_Final IS NULL OR IR_Final = 0 THEN 0 ELSE least(greatest(coalesce(PIK_Final, 0) / IR_Final, 0), 1) END AS pik_share FROM tr),
s1 AS (
  SELECT *, row_number() OVER w > 1 AS seasoned, coalesce(PIK_Final, 0) >= 0.0025 AS now_, coalesce(lag(PIK_Final) OVER w, 0) >= 0.0025 AS before_,
    pik_share - coalesce(lag(pik_share) OVER w, 0) >= 0.10 AS risen FROM s0 WINDOW w AS (PARTITION BY cik, borrower ORDER BY qsort)
),
s2 AS (SELECT *, (seasoned AND now_ AND (NOT before_ OR risen)) AS toggled FROM s1),
s3 AS (SELECT *, (now_ AND max(toggled) OVER (PARTITION BY cik, borrower ORDER BY qsort)) AS acquired FROM s2),
fp0 AS (SELECT cal_q, borrower, family, sum(FV_px) / sum(PAR_px) AS p FROM tr WHERE PAR_px > 0 GROUP BY ALL),
fp AS (SELECT * FROM fp0 WHERE p <= 1.2 AND (cal_q, borrower) IN (SELECT (cal_q, borrower) FROM fp0 GROUP BY ALL HAVING count(*) >= 2)),
dispersion AS (
  SELECT cal_q, borrower, quantile_cont(p, 0.5) AS V4, stddev_samp(p) AS V1_std, max(p) - min(p) AS V1_range, min(p) - quantile_cont(p, 0.5) AS V2_low_mark
  FROM fp GROUP BY ALL HAVING count(*) >= 2
),
fam AS (SELECT cal_q, borrower, family, sum(PAR) AS par FROM rows_ WHERE PAR > 0 AND FV > 0 AND borrower IS NOT NULL GROUP BY ALL),
cr AS (
  SELECT cal_q, borrower, count(*) AS C1_families, sum(par * par) / (sum(par) * sum(par)) AS C2_lender_hhi, max(par) / sum(par) AS C3_top_share, ln(sum(par)) AS log_borrower_par,
    CAST(substr(cal_q, 1, 4) AS INT) * 4 + CAST(substr(cal_q, 6, 1) AS INT) AS q FROM fam GROUP BY cal_q, borrower
),
crowd AS (
  SELECT cr.*, CASE WHEN cr.q - 4 >= (SELECT min(q) FROM cr) THEN cr.C1_families - coalesce(o.C1_families, 0) END AS C4_d_families
  FROM cr LEFT JOIN cr o ON o.borrower = cr.borrower AND o.q = cr.q - 4
),
monitor AS (
  SELECT s3.*, V1_std, V1_range, V2_low_mark, fp.p - V4 AS mark_vs_consensus, abs(fp.p - V4) AS mark_distance, C1_families, C2_lender_hhi, C3_top_share, C4_d_families, log_borrower_par
  FROM s3 LEFT JOIN dispersion d ON d.cal_q = s3.cal_q AND d.borrower = s3.borrower
  LEFT JOIN fp ON fp.cal_q = s3.cal_q AND fp.borrower = s3.borrower AND fp.family = s3.family AND d.V4 IS NOT NULL
  LEFT JOIN crowd c ON c.cal_q = s3.cal_q AND c.borrower = s3.borrower
)"""

PANEL_SQL = f"""{MONITOR_SQL},
held AS (SELECT cal_q, cik, borrower, sum(COST) AS cost FROM rows_ WHERE COST > 0 GROUP BY ALL),
lw AS (
  SELECT borrower, cal_q, max(cost / book) AS max_lender_weight, sum(cost / book * cost) / sum(cost) AS mean_lender_weight
  FROM (SELECT *, sum(cost) OVER (PARTITION BY cal_q, cik) AS book FROM held) WHERE borrower IS NOT NULL GROUP BY ALL
),
panel0 AS (
  SELECT borrower, cal_q, min(qsort) AS qsort, min_by(sector, cik || '|' || borrower) AS sector, sum(PAR) AS par, sum(FV) AS fv, sum(COST) AS cost, sum(FV_px) AS fv_px, sum(PAR_px) AS par_px,
    max(C1_families) AS C1_families, max(C2_lender_hhi) AS C2_lender_hhi, max(C3_top_share) AS C3_top_share, max(C4_d_families) AS C4_d_families,
    max(log_borrower_par) AS log_borrower_par, count(V1_std) > 0 AS multi_family, {_mean_sql("V1_std")} AS V1_std, {_mean_sql("V1_range")} AS V1_range,
    {_mean_sql("V2_low_mark")} AS V2_low_mark, {_mean_sql("mark_distance")} AS mark_distance, {_mean_sql("pik_share")} AS pik_share,
    sum(CASE WHEN pik_share > 0 THEN PAR ELSE 0 END) / sum(PAR) AS pik_par_share, sum(CASE WHEN toggled THEN PAR ELSE 0 END) / sum(PAR) AS toggle_par_share,
    sum(CASE WHEN acquired THEN PAR ELSE 0 END) / sum(PAR) AS acquired_par_share,
    sum(COST * non_accrual) / nullif(sum(CASE WHEN non_accrual IS NOT NULL THEN COST END), 0) AS na_cost_share
  FROM monitor GROUP BY borrower, cal_q
),
panel AS (
  SELECT p.*, CASE WHEN par_px > 0 AND fv_px / par_px <= 1.5 THEN fv_px / par_px END AS price, max_lender_weight, mean_lender_weight
  FROM panel0 p LEFT JOIN lw ON lw.borrower = p.borrower AND lw.cal_q = p.cal_q
),
sized AS (
  SELECT *, CAST(greatest(1, ceil(round(5.0 * (row_number() OVER (PARTITION BY cal_q ORDER BY par, borrower) - 1) / greatest(count(*) OVER (PARTITION BY cal_q) - 1, 1), 9))) AS INT) AS size_group
  FROM panel
),
signs0 AS (
  SELECT *, {_upper_sql("C1_families", "cal_q, size_group")} AS crowding_upper_share, {_upper_sql("round(V1_range, 12)", "cal_q")} AS disagreement_upper_share,
    max(CASE WHEN toggle_par_share > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY borrower ORDER BY qsort RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS switched
  FROM sized
),
signs1 AS (
  SELECT *, CAST(crowding_upper_share <= 0.1 AS INT) AS crowding, CAST(disagreement_upper_share <= 0.1 AS INT) AS disagreement, CAST(pik_share > 0.5 AS INT) AS pik_half,
    CASE WHEN cal_q > (SELECT min(cal_q) FROM panel) THEN CAST(toggle_par_share > 0 AS INT) END AS pik_switch_q, CASE WHEN cal_q >= '{HISTORY_FROM}' THEN switched END AS pik_switched
  FROM signs0
),
signs AS (SELECT *, greatest(coalesce(disagreement, 0), coalesce(pik_switched, 0)) AS distress FROM signs1)"""
SIGNS = (*exposure.SIGNS, "distress")
_PANEL_MEASURES = (
    "C1_families C2_lender_hhi C3_top_share C4_d_families log_borrower_par V1_std V1_range V2_low_mark mark_distance pik_share pik_par_share toggle_par_share "
    "acquired_par_share na_cost_share price max_lender_weight mean_lender_weight"
).split()
_MONITOR_MEASURES = "pik_share V1_std V1_range V2_low_mark mark_vs_consensus mark_distance C2_lender_hhi C3_top_share log_borrower_par".split()


def _round_sql(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query(f"""WITH {MONITOR_SQL}
SELECT cik || '|' || borrower AS chain_id, cal_q, toggled AS is_distress_amendment, acquired AS pik_acquired, CAST(C1_families AS BIGINT) AS C1_families,
  CAST(C4_d_families AS BIGINT) AS C4_d_families, {_round_sql(_MONITOR_MEASURES)} FROM monitor""")
def monitor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_monitor(spark, sf_dir).select("chain_id", "cal_q", "is_distress_amendment", "pik_acquired", "C1_families", "C4_d_families", *_MONITOR_MEASURES))


@query(f"""WITH {PANEL_SQL}
SELECT borrower, cal_q, CAST(qsort AS INT) AS qsort, sector, multi_family, {_round_sql(("par", "fv", "cost", *_PANEL_MEASURES))} FROM panel""")
def borrower_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _panel(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("C1_families", "C4_d_families")})
    return rounded(found.select("borrower", "cal_q", "qsort", "sector", "multi_family", "par", "fv", "cost", *_PANEL_MEASURES))


@query(f"""WITH {PANEL_SQL}
SELECT cal_q, borrower, {_round_sql(("max_lender_weight", "mean_lender_weight"))} FROM lw""")
def lender_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure.lender_weights(_rows(spark, sf_dir)))


@query(f"""WITH {PANEL_SQL}
SELECT borrower, cal_q, size_group, {_round_sql(("crowding_upper_share", "disagreement_upper_share"))}, {", ".join(SIGNS)} FROM signs""")
def warning_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_flags(spark, sf_dir).select("borrower", "cal_q", "size_group", "crowding_upper_share", "disagreement_upper_share", *SIGNS))


@query(f"""WITH {PANEL_SQL},
long_ AS ({" UNION ALL ".join(f"SELECT '{s}' AS sign, cal_q, par, {s} AS on_ FROM signs" for s in SIGNS)})
SELECT sign, cal_q, CAST(count(*) AS BIGINT) AS borrowers, CAST(sum(on_) AS BIGINT) AS flagged, round(sum(on_ * par), 2) AS par_flagged, round(sum(par), 2) AS par,
  round(avg(on_), 6) AS share, round(sum(on_ * par) / sum(par), 6) AS par_share FROM long_ WHERE on_ IS NOT NULL GROUP BY sign, cal_q""")
def warning_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exposure.warning_tail(_flags(spark, sf_dir))
    return rounded(found.withColumns({c: F.round(c, 2) for c in ("par", "par_flagged")}))


@query(f"""WITH {PANEL_SQL} SELECT borrower, cal_q, size_group FROM sized""")
def size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.size_groups(_panel(spark, sf_dir)).select("borrower", "cal_q", "size_group")


@query(f"""WITH {PANEL_SQL},
p AS (SELECT cal_q, CASE WHEN C1_families <= 3 THEN CAST(C1_families AS VARCHAR) WHEN C1_families <= 5 THEN '4-5' ELSE '6+' END AS bucket, count(*) AS n, sum(par) AS par FROM panel
  WHERE C1_families IS NOT NULL AND par > 0 GROUP BY ALL)
SELECT cal_q, bucket, CAST(n AS BIGINT) AS borrowers, round(par, 2) AS par, CAST(sum(n) OVER (PARTITION BY cal_q) AS BIGINT) AS all_borrowers, round(sum(par) OVER (PARTITION BY cal_q), 2) AS all_par,
  round(n / sum(n) OVER (PARTITION BY cal_q), 6) AS share_borrowers, round(par / sum(par) OVER (PARTITION BY cal_q), 6) AS share_par FROM p""")
def crowding_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exposure.crowding_distribution(_panel(spark, sf_dir))
    return rounded(found.withColumns({c: F.round(c, 2) for c in ("par", "all_par")}))


def _quantiles_sql(x: str, table: str, points=(0.5, 0.9, 0.95), suffix: str = "") -> str:
    """The least value at which the running share of par reaches each point, by quarter."""
    least = ", ".join(f"round(min(CASE WHEN share >= {q} - 1e-12 THEN x END), 6) AS p{round(100 * q)}{suffix}" for q in points)
    return (
        f"SELECT cal_q, {least} FROM (SELECT *, sum(w) OVER (PARTITION BY cal_q ORDER BY x) / sum(w) OVER (PARTITION BY cal_q) AS share"
        f" FROM (SELECT cal_q, {x} AS x, sum(par) AS w FROM {table} WHERE {x} IS NOT NULL AND par > 0 GROUP BY ALL)) GROUP BY cal_q"
    )


@query(f"WITH {PANEL_SQL} " + _quantiles_sql("price", "panel"))
def weighted_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure.weighted_quantiles(_panel(spark, sf_dir), "price", "par", (0.5, 0.9, 0.95)))


@query(f"""WITH {PANEL_SQL}, d AS ({_quantiles_sql("V1_range", "panel", suffix="_dollars")}),
b AS (SELECT cal_q, CAST(count(*) AS BIGINT) AS borrowers, round(sum(par), 2) AS par, round(quantile_cont(V1_range, 0.5), 6) AS p50_borrowers, round(quantile_cont(V1_range, 0.9), 6) AS p90_borrowers,
  round(quantile_cont(V1_range, 0.95), 6) AS p95_borrowers FROM panel WHERE V1_range IS NOT NULL AND par > 0 GROUP BY cal_q)
SELECT b.*, p50_dollars, p90_dollars, p95_dollars FROM b JOIN d ON d.cal_q = b.cal_q""")
def disagreement_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exposure.disagreement_percentiles(_panel(spark, sf_dir))
    return rounded(found.withColumn("par", F.round("par", 2)))


_EXPOSURE_SQL = f"""{PANEL_SQL},
books AS (
  SELECT cik, cal_q, sum(FV) AS portfolio_fv, max(bdc_type) AS bdc_type FROM rows_ WHERE FV > 0 GROUP BY ALL
),
e AS (
  SELECT h.*, portfolio_fv, bdc_type, h.fv / portfolio_fv AS weight, {", ".join(f"coalesce(s.{x}, 0) AS {x}" for x in SIGNS)}
  FROM (SELECT cik, cal_q, borrower, sum(FV) AS fv, sum(COST) AS cost FROM rows_ WHERE FV > 0 AND borrower IS NOT NULL GROUP BY ALL) h
  JOIN books b ON b.cik = h.cik AND b.cal_q = h.cal_q LEFT JOIN signs s ON s.cal_q = h.cal_q AND s.borrower = h.borrower
),
x AS (
  SELECT cik, cal_q, CAST(count(*) AS BIGINT) AS n_borrowers, max(portfolio_fv) AS portfolio_fv, max(bdc_type) AS bdc_type, sum(cost * cost) / (sum(cost) * sum(cost)) AS concentration,
    {", ".join(f"sum(weight * {s}) AS exposure_{s}" for s in SIGNS)}, coalesce(max(CASE WHEN distress = 1 THEN weight END), 0) AS top_flagged_weight,
    max_by(borrower, weight) FILTER (WHERE distress = 1) AS top_flagged
  FROM e GROUP BY cik, cal_q HAVING count(*) >= 5
)"""
_EXPOSURES = [f"exposure_{s}" for s in SIGNS]


def _exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return exposure.lender_exposure(rows, _flags(spark, sf_dir), least_borrowers=5)


@query(f"""WITH {_EXPOSURE_SQL}
SELECT cik, cal_q, n_borrowers, bdc_type, top_flagged, round(portfolio_fv, 2) AS portfolio_fv, round(1 / concentration, 4) AS effective_n,
  {_round_sql((*_EXPOSURES, "concentration", "top_flagged_weight"))} FROM x""")
def lender_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _exposure(spark, sf_dir).withColumns({"effective_n": F.round("effective_n", 4), "portfolio_fv": F.round("portfolio_fv", 2)})
    return rounded(found)


@query(f"""WITH {_EXPOSURE_SQL}
SELECT cal_q, CAST(count(*) AS BIGINT) AS bdcs, round(quantile_cont(exposure_distress, 0.5), 6) AS median_exposure, CAST(sum(CAST(exposure_distress > 0.2 AS INT)) AS BIGINT) AS over_line,
  round(avg(CAST(exposure_distress > 0.2 AS INT)), 6) AS share_over_line, CAST(sum(CAST(top_flagged_weight > 0.05 AS INT)) AS BIGINT) AS single_name_over,
  round(avg(CAST(top_flagged_weight > 0.05 AS INT)), 6) AS share_single_name_over FROM x GROUP BY cal_q""")
def exposure_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure.exposure_by_quarter(_exposure(spark, sf_dir)))


@query("""SELECT l_orderkey AS row_a, l_linenumber AS row_b, round(CASE WHEN x BETWEEN 0.02 AND 0.5 THEN x
  WHEN s100 AND (NOT s10k OR abs(x / 100 - 0.26) <= abs(x / 10000 - 0.26)) THEN x / 100 WHEN s10k THEN x / 10000 ELSE x END, 8) AS value,
  CASE WHEN x BETWEEN 0.02 AND 0.5 THEN 'unchanged' WHEN s100 AND (NOT s10k OR abs(x / 100 - 0.26) <= abs(x / 10000 - 0.26)) THEN 'div100' WHEN s10k THEN 'div10000' ELSE 'unresolved' END AS done
FROM (SELECT *, x / 100 BETWEEN 0.02 AND 0.5 AS s100, x / 10000 BETWEEN 0.02 AND 0.5 AS s10k FROM
  (SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN l_linenumber % 3 = 0 THEN 0.01 WHEN l_linenumber % 3 = 1 THEN 1 ELSE 100 END AS x FROM lineitem))""")
def rescale_to_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber") % 3
    x = F.col("l_quantity") * F.when(n == 0, 0.01).when(n == 1, 1.0).otherwise(100.0)
    value, done = rates.rescale(F.col("x"), 0.02, 0.5)
    out = line.select(F.col("l_orderkey").alias("row_a"), F.col("l_linenumber").alias("row_b"), x.alias("x"))
    return out.select("row_a", "row_b", F.round(value, 8).alias("value"), done.alias("done"))


STATUS_SQL = f"""{PANEL_SQL},
ls AS (SELECT borrower, qsort, cik, max(non_accrual) AS status, sum(FV) AS fv FROM rows_ WHERE borrower IS NOT NULL GROUP BY ALL)"""


def _lenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit.lender_status(_rows(spark, sf_dir).where("borrower is not null"))


@query(f"""WITH {STATUS_SQL},
b AS (SELECT borrower, qsort, CAST(max(status) AS INT) AS na_status, CAST(count(status) AS BIGINT) AS n_lenders_known, sum(fv) AS fv FROM ls GROUP BY ALL)
SELECT borrower, qsort, na_status, n_lenders_known, round(fv, 2) AS fv_debt, CAST(max(coalesce(na_status, 0)) OVER (PARTITION BY borrower ORDER BY qsort) AS INT) AS na_ever FROM b""")
def borrower_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit.borrower_status(_lenders(spark, sf_dir)).withColumn("fv_debt", F.round("fv_debt", 2))


@query(f"""WITH {STATUS_SQL}
SELECT DISTINCT a.borrower, a.qsort FROM ls a JOIN ls b ON a.borrower = b.borrower AND a.cik = b.cik AND b.qsort BETWEEN a.qsort + 1 AND a.qsort + 2
WHERE a.status = 0 AND b.status = 1""")
def same_lender_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit.same_lender_entries(_lenders(spark, sf_dir))


@query("""WITH e AS (
  SELECT user_id, event_type, ts, lag(event_type) OVER w AS before, lag(ts) OVER w AS ts_before, lead(event_type) OVER w AS after
  FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CASE WHEN event_type = 'signup' THEN ts WHEN before = 'signup' THEN ts_before END AS "start", CASE WHEN event_type = 'error' THEN ts END AS "end"
FROM e WHERE event_type = 'error' OR after IS NULL""")
def status_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit.status_intervals(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "signup", "error", "event_id")


LOANS_SQL = f"""{MONITOR_SQL},
loans AS (
  SELECT cik || '|' || borrower AS chain_id, cik, borrower, qsort, toggled, PIK_Final, IR_Final, PAR, COST, FV, maturity, spread, non_accrual,
    lag(qsort) OVER w IS NOT NULL AS linked, lag(PIK_Final) OVER w AS PIK_p, lag(IR_Final) OVER w AS IR_p, lag(PAR) OVER w AS PAR_p, lag(COST) OVER w AS COST_p, lag(FV) OVER w AS FV_p,
    lag(maturity) OVER w AS maturity_p, lag(spread) OVER w AS spread_p, CASE WHEN coalesce(FV_px / nullif(PAR_px, 0), FV / COST) <= 1.5 THEN coalesce(FV_px / nullif(PAR_px, 0), FV / COST) END AS mark
  FROM monitor WINDOW w AS (PARTITION BY cik, borrower ORDER BY qsort)
)"""


def _changes_sql(pik: str, step: float, days: int, share: float) -> str:
    kinds = {
        "pik": pik,
        "spread": f"spread - spread_p >= {step} - 1e-9 AND IR_Final - IR_p >= spread - spread_p - 0.0075",
        "maturity": f"maturity - maturity_p >= {days}",
        "write_down": f"COST_p - COST >= {share} * PAR_p AND PAR >= 0.98 * PAR_p AND COST_p - FV_p >= {share} * PAR_p",
    }
    return "SELECT chain_id, cik, borrower, qsort, linked, " + ", ".join(f"CAST(linked AND coalesce({v}, false) AS INT) AS {k}" for k, v in kinds.items()) + " FROM loans"


CHANGED_SQL = f"""{LOANS_SQL},
changes AS ({_changes_sql("toggled", 0.0050, 90, 0.05)})"""
EXITS_SQL = f"""{CHANGED_SQL},
debt AS (SELECT DISTINCT borrower, qsort, cik FROM rows_ WHERE borrower IS NOT NULL),
eq AS (SELECT DISTINCT borrower, qsort, cik FROM rows_ WHERE borrower IS NOT NULL AND NOT price_ok),
new_eq AS (SELECT * FROM eq e WHERE NOT EXISTS (FROM eq o WHERE o.borrower = e.borrower AND o.cik = e.cik AND o.qsort = e.qsort - 1) AND EXISTS (FROM eq o WHERE o.cik = e.cik AND o.qsort = e.qsort - 1)),
ends AS (SELECT * FROM (SELECT *, max(qsort) OVER (PARTITION BY chain_id) AS last_, max(qsort) OVER () AS end_ FROM loans) WHERE qsort = last_ AND qsort < end_),
facts AS (
  SELECT x.*, qsort + 1 AS exit_q, EXISTS (FROM debt d WHERE d.cik = x.cik AND d.qsort = x.qsort + 1) AS filed,
    EXISTS (FROM rows_ r WHERE r.borrower = x.borrower AND r.cik = x.cik AND r.qsort = x.qsort + 1 AND r.non_accrual = 1) AS na_next,
    EXISTS (FROM new_eq n WHERE n.borrower = x.borrower AND n.cik = x.cik AND n.qsort = x.qsort + 1) AS swapped,
    EXISTS (FROM loans n WHERE n.borrower = x.borrower AND n.cik = x.cik AND n.qsort = x.qsort + 1 AND NOT n.linked) AS again,
    EXISTS (FROM debt d WHERE d.borrower = x.borrower AND d.cik <> x.cik AND d.qsort = x.qsort + 1) AS other,
    EXISTS (FROM loans n WHERE n.borrower = x.borrower AND n.cik <> x.cik AND n.qsort = x.qsort + 1 AND NOT n.linked) AS other_new
  FROM ends x
),
reasons AS (
  SELECT chain_id, cik, borrower, qsort, exit_q, mark, CAST(swapped AS INT) AS equity, CASE WHEN coalesce(non_accrual = 1, false) OR na_next THEN 'non-accrual' WHEN mark <= 0.8 THEN 'marked well below par'
    WHEN swapped THEN 'replaced by equity' WHEN again AND filed THEN 'new tranche, same BDC' WHEN other AND other_new THEN 'another BDC, new loan that quarter' WHEN other THEN 'another BDC, already lending'
    WHEN mark >= 0.95 AND filed THEN 'last mark near par' WHEN filed THEN 'neither near nor well below par, or no mark' ELSE 'BDC did not file next quarter' END AS exit_reason FROM facts
),
exits AS (
  SELECT *, CASE WHEN exit_reason IN ('non-accrual', 'marked well below par', 'replaced by equity') THEN 'impaired' WHEN exit_reason LIKE '%BDC,%' OR exit_reason LIKE '%, same BDC' THEN 'refinanced'
    WHEN exit_reason = 'last mark near par' THEN 'repaid' ELSE 'unresolved' END AS exit_class FROM reasons
),
ev0 AS (SELECT borrower, qsort, pik, spread, maturity, 0 AS equity, write_down FROM changes UNION ALL SELECT borrower, exit_q, 0, 0, 0, 1, 0 FROM exits WHERE equity = 1),
ev AS (SELECT borrower, qsort, max(pik) AS pik, max(spread) AS spread, max(maturity) AS maturity, max(equity) AS equity, max(write_down) AS write_down,
  max(greatest(pik, spread, maturity, equity, write_down)) AS restructured, max(greatest(pik, equity, write_down)) AS concession FROM ev0 GROUP BY ALL)"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, ("linked", sf_dir), lambda: _linked_loans(_rows(spark, sf_dir)))


def _linked_loans(rows: DataFrame) -> DataFrame:
    loans = crowding.pik_transitions(_loans(rows), keys=("cik", "chain_id"), percentiles=False)
    return events.loans(loans.withColumn("borrower", F.col("borrower_key")))


def _exits(spark: SparkSession, sf_dir: str, cutoffs: events.Cutoffs = events.PRIMARY) -> DataFrame:
    return kept(spark, ("exits", sf_dir, cutoffs), lambda: _ended_loans(spark, sf_dir, _linked(spark, sf_dir), cutoffs))


def _ended_loans(spark: SparkSession, sf_dir: str, linked: DataFrame, cutoffs: events.Cutoffs) -> DataFrame:
    rows = _rows(spark, sf_dir).where("borrower is not null").withColumn("cik", F.col("cik").cast("long"))
    equity = rows.where("not price_ok").select("borrower", "qsort", "cik").distinct()
    return events.loan_exits(linked, rows.select("borrower", "qsort", "cik"), credit.lender_status(rows), equity, cutoffs)


@query(f"WITH {CHANGED_SQL} SELECT chain_id, qsort, linked, pik, spread, maturity, write_down FROM changes")
def term_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.term_changes(_linked(spark, sf_dir)).drop("cik", "borrower")


@query(f"WITH {LOANS_SQL}, changes AS ({_changes_sql('coalesce(PIK_Final, 0) >= 0.0025 AND coalesce(PIK_p, 0) < 0.0025', 0.0100, 365, 0.10)}) SELECT chain_id, qsort, linked, pik, spread, maturity, write_down FROM changes")
def term_changes_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.term_changes(_linked(spark, sf_dir), events.SECOND).drop("cik", "borrower")


@query(f"WITH {EXITS_SQL} SELECT chain_id, CAST(exit_q AS INT) AS exit_q, round(mark, 6) AS mark, exit_class, exit_reason, equity FROM exits")
def loan_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_exits(spark, sf_dir).drop("cik", "borrower", "qsort"))


@query(f"WITH {EXITS_SQL} SELECT borrower, CAST(qsort AS INT) AS qsort, pik, spread, maturity, equity, write_down, restructured, concession FROM ev")
def borrower_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _linked(spark, sf_dir)
    return events.borrower_events(events.term_changes(linked), _exits(spark, sf_dir))


_SECOND_SQL = """reasons_ AS (
  SELECT chain_id, CASE WHEN coalesce(non_accrual = 1, false) OR na_next THEN 'non-accrual' WHEN mark <= 0.9 THEN 'marked well below par'
    WHEN swapped THEN 'replaced by equity' WHEN again AND filed THEN 'new tranche, same BDC' WHEN other AND other_new THEN 'another BDC, new loan that quarter' WHEN other THEN 'another BDC, already lending'
    WHEN mark >= 0.98 AND filed THEN 'last mark near par' WHEN filed THEN 'neither near nor well below par, or no mark' ELSE 'BDC did not file next quarter' END AS exit_reason FROM facts
),
exits_ AS (
  SELECT *, CASE WHEN exit_reason IN ('non-accrual', 'marked well below par', 'replaced by equity') THEN 'impaired' WHEN exit_reason LIKE '%BDC,%' OR exit_reason LIKE '%, same BDC' THEN 'refinanced'
    WHEN exit_reason = 'last mark near par' THEN 'repaid' ELSE 'unresolved' END AS exit_class FROM reasons_
),
both_ AS (SELECT exit_class, exit_reason, 1 AS a, 0 AS b FROM exits UNION ALL SELECT exit_class, exit_reason, 0, 1 FROM exits_)"""


@query(f"""WITH {EXITS_SQL}, {_SECOND_SQL}
SELECT exit_class, exit_reason, CAST(sum(a) AS BIGINT) AS loans_primary, CAST(sum(b) AS BIGINT) AS loans_second, round(sum(a) / (SELECT sum(a) FROM both_), 6) AS share_primary,
  round(sum(b) / (SELECT sum(b) FROM both_), 6) AS share_second FROM both_ GROUP BY ROLLUP (exit_class, exit_reason)""")
def exit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events.exit_counts(_exits(spark, sf_dir), _exits(spark, sf_dir, events.SECOND), 10**6)
    return rounded(counted.select("exit_class", "exit_reason", "loans_primary", "loans_second", "share_primary", "share_second"))


@query(f"""WITH {EXITS_SQL},
b AS (SELECT borrower, qsort, CAST(max(non_accrual) AS INT) AS na_status FROM rows_ WHERE borrower IS NOT NULL GROUP BY ALL),
lined AS (SELECT coalesce(b.borrower, ev.borrower) AS borrower, coalesce(b.qsort, ev.qsort) AS qsort, na_status, b.borrower IS NOT NULL AS held, concession, restructured
  FROM b FULL JOIN ev ON ev.borrower = b.borrower AND ev.qsort = b.qsort),
w AS (
  SELECT *, max(CASE WHEN na_status = 1 THEN 1 ELSE 0 END) OVER w = 1 AS flagged, max(concession) OVER w = 1 AS conceded, max(restructured) OVER w = 1 AS changed, count(CASE WHEN na_status = 0 THEN 1 END) OVER w AS clean,
    count(CASE WHEN held THEN 1 END) OVER w AS n_held, min(CASE WHEN na_status = 1 OR concession = 1 THEN qsort END) OVER w AS event_q, qsort + 2 <= (SELECT max(qsort) FROM b) AS whole
  FROM lined WINDOW w AS (PARTITION BY borrower ORDER BY qsort RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING)
),
v AS (SELECT *, coalesce(flagged, false) AS f, coalesce(flagged, false) OR coalesce(conceded, false) AS e, coalesce(flagged, false) OR coalesce(changed, false) AS a, na_status = 0 AND whole AS risk FROM w WHERE held)
SELECT borrower, CAST(qsort AS INT) AS qsort, na_status, CAST(event_q AS INT) AS event_q, CASE WHEN risk THEN CASE WHEN e THEN 1 WHEN clean = 2 THEN 0 END END AS y_event,
  CASE WHEN risk THEN CASE WHEN f THEN 1 WHEN clean = 2 THEN 0 END END AS y_na, CASE WHEN risk THEN CASE WHEN a THEN 1 WHEN clean = 2 THEN 0 END END AS y_all_terms, whole AND NOT e AND n_held < 2 AS exited FROM v""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _linked(spark, sf_dir)
    exits = _exits(spark, sf_dir)
    lenders = _lenders(spark, sf_dir)
    happened = events.borrower_events(events.term_changes(linked), exits)
    status = credit.borrower_status(lenders)
    found = events.add_targets(status.select("borrower", "qsort"), status, credit.same_lender_entries(lenders), happened, exits)
    return found.select("borrower", "qsort", "na_status", "event_q", "y_event", "y_na", "y_all_terms", "exited")


@query(f"""WITH {MONITOR_SQL},
marks AS (SELECT *, CASE WHEN PAR_px > 0 AND FV_px / PAR_px <= 1.5 THEN FV_px / PAR_px END AS mark FROM monitor),
lagged AS (
  SELECT *, lag(qsort) OVER w AS q_was, lag(mark) OVER w AS mark_was, lag(PAR_px) OVER w AS par_px_was, lag(PAR) OVER w AS par_was, lag(pik_share) OVER w AS share_was, lag(FV) OVER w AS fv_was, lag(COST) OVER w AS cost_was
  FROM marks WINDOW w AS (PARTITION BY cik, borrower ORDER BY qsort)
),
c AS (
  SELECT borrower, qsort, sum(par_px_was * (mark - mark_was)) / nullif(sum(CASE WHEN mark - mark_was IS NOT NULL THEN par_px_was END), 0) AS d_price,
    sum(FV - fv_was - (COST - cost_was)) AS gain, sum(fv_was + greatest(COST - cost_was, 0)) AS base, 100 * sum(par_was * (pik_share - share_was)) / sum(par_was) AS d_pik_pp
  FROM lagged WHERE qsort - q_was = 1 GROUP BY ALL
),
b AS (
  SELECT borrower, qsort, CASE WHEN sum(PAR_px) > 0 AND sum(FV_px) / sum(PAR_px) <= 1.5 THEN sum(FV_px) / sum(PAR_px) END AS price, sum(PAR_px) / sum(PAR) AS priced_share,
    count(DISTINCT family) AS crowding, {_mean_sql("V1_range")} AS dispersion, CASE WHEN max(seasoned) THEN max(CAST(toggled AS INT)) END AS pik_switch
  FROM monitor GROUP BY ALL
)
SELECT b.borrower, CAST(b.qsort AS INT) AS qsort, pik_switch, {_round_sql(("price", "priced_share", "crowding", "dispersion", "d_price", "d_pik_pp"))},
  CASE WHEN base > 0 AND gain IS NOT NULL THEN round(least(greatest(gain / base, -1), 1), 6) END AS val_ret, round(price - median(price) OVER (PARTITION BY b.qsort), 6) AS price_rel,
  round(d_price - median(d_price) OVER (PARTITION BY b.qsort), 6) AS d_price_adj
FROM b LEFT JOIN c ON c.borrower = b.borrower AND c.qsort = b.qsort""")
def borrower_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("instrument_seniority", F.lit("UNITRANCHE"))
    found = features.build_features(exposure.monitor_panel(_loans(rows), rows), rows)
    names = ("pik_switch", "price", "priced_share", "crowding", "dispersion", "d_price", "d_pik_pp", "val_ret", "price_rel", "d_price_adj")
    return rounded(found.select("borrower", "qsort", *names))


CHANGES_SQL = f"""{PANEL_SQL},
ch AS (SELECT borrower, qsort, CASE WHEN lag(qsort) OVER w = qsort - 1 THEN price - lag(price) OVER w END AS d_price FROM panel WINDOW w AS (PARTITION BY borrower ORDER BY qsort))"""


@query(f"""WITH {CHANGES_SQL},
bounds AS (SELECT min(qsort) AS lo, max(qsort) AS hi FROM ch),
grid AS (SELECT borrower, lo, unnest(range(lo, hi + 1)) AS qsort FROM (SELECT DISTINCT borrower FROM ch), bounds),
lv AS (SELECT g.borrower, g.qsort, lo, d_price, sum(coalesce(d_price, 0)) OVER (PARTITION BY g.borrower ORDER BY g.qsort) AS level
  FROM grid g LEFT JOIN ch c ON c.borrower = g.borrower AND c.qsort = g.qsort)
SELECT a.borrower, CAST(a.qsort AS INT) AS qsort, round(CASE WHEN max(seen) > 0 THEN max(p.level - t.level) END, 6) AS drawdown
FROM (SELECT *, count(CASE WHEN qsort > lo THEN d_price END) OVER (PARTITION BY borrower ORDER BY qsort ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS seen FROM lv) a
JOIN lv p ON p.borrower = a.borrower AND p.qsort BETWEEN a.qsort - 4 AND a.qsort JOIN lv t ON t.borrower = a.borrower AND t.qsort BETWEEN p.qsort AND a.qsort
GROUP BY a.borrower, a.qsort""")
def rolling_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("borrower").orderBy("qsort")
    panel = _panel(spark, sf_dir).select("borrower", "qsort", "price")
    follows = F.lag("qsort").over(before) == F.col("qsort") - 1
    changes = panel.withColumn("d_price", F.when(follows, F.col("price") - F.lag("price").over(before)))
    return rounded(credit.rolling_max_drawdown(changes))


SCORES_SQL = f"""{PANEL_SQL},
sc AS (SELECT borrower, qsort, round(10 * (1 - price), 9) AS pred, CAST(na_cost_share > 0.5 AS INT) AS y FROM panel WHERE price IS NOT NULL AND na_cost_share IS NOT NULL),
pl AS (SELECT *, row_number() OVER (PARTITION BY qsort ORDER BY pred DESC, borrower) / count(*) OVER (PARTITION BY qsort) AS r FROM sc)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir).where("price is not null and na_cost_share is not null")
    return panel.select(
        "borrower", "qsort", F.round(10 * (1 - F.col("price")), 9).alias("pred"), (F.col("na_cost_share") > 0.5).cast("int").alias("y")
    )


@query(f"""WITH {SCORES_SQL},
d AS (SELECT CAST(11 - ceil(round(r * 10, 9)) AS INT) AS decile, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS events, sum(pred) AS expected FROM pl GROUP BY 1)
SELECT decile, n, events, round(events / n, 6) AS event_rate, round(expected / n, 6) AS predicted_rate, round(events / expected, 6) AS realized_to_predicted,
  round(events / sum(events) OVER (), 6) AS share_of_events FROM d""")
def decile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.decile_table(_scores(spark, sf_dir)))


@query(f"""WITH {SCORES_SQL},
c AS (SELECT qsort, CAST(sum(CASE WHEN r <= 0.1 THEN y ELSE 0 END) AS BIGINT) AS caught, CAST(sum(y) AS BIGINT) AS events FROM pl GROUP BY GROUPING SETS ((qsort), ()))
SELECT CAST(qsort AS INT) AS qsort, caught, events, round(caught / nullif(events, 0), 6) AS recall FROM c""")
def recall_of_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.recall_at(_scores(spark, sf_dir), 0.1))


@query(f"""WITH {SCORES_SQL},
k AS (SELECT *, rank() OVER (PARTITION BY qsort ORDER BY pred) + (count(*) OVER (PARTITION BY qsort, pred) - 1) / 2 AS place FROM sc),
a AS (SELECT qsort, sum(y) AS n1, count(*) - sum(y) AS n0, sum(y * place) AS s FROM k GROUP BY qsort)
SELECT qsort, round(CASE WHEN n1 * n0 > 0 THEN (s - n1 * (n1 + 1) / 2) / (n1 * n0) END, 6) AS auc FROM a""")
def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.roc_auc(_scores(spark, sf_dir)))


@query(f"""WITH {SCORES_SQL},
g AS (SELECT qsort, pred, sum(y) AS pos, count(*) AS n FROM sc GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w / sum(n) OVER w AS precision_ FROM g WINDOW w AS (PARTITION BY qsort ORDER BY pred DESC))
SELECT qsort, round(sum(pos * precision_) / nullif(sum(pos), 0), 6) AS average_precision FROM t GROUP BY qsort""")
def score_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.average_precision(_scores(spark, sf_dir)))


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported rates with gaps, from the sales table: every mix of missing fields occurs."""
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("row_a"),
        F.col("l_linenumber").alias("row_b"),
        F.when(k % 3 != 0, F.when(k % 5 == 0, discount).otherwise(discount + tax)).alias("rate"),
        F.when(k % 4 != 1, discount).alias("spread"),
        F.when(part % 3 == 0, tax / 2).alias("pik"),
        F.when(part % 4 == 1, tax + F.when(k % 7 == 0, 0.03).otherwise(0.0)).alias("pic"),
        F.when(k % 9 != 0, F.lit(0.051) - F.when(part % 10 == 0, 0.06).otherwise(0.0)).alias("base"),
        F.when(part % 6 == 0, F.lit(0.06)).when(part % 6 == 1, F.lit(0.01)).alias("floor"),
        F.when(part % 5 == 0, F.lit(True)).when(part % 5 < 3, F.lit(False)).alias("is_fixed"),
        (part % 8 == 0).alias("is_prime"),
        F.when(part % 2 == 0, "USD").otherwise("EUR").alias("currency"),
    )


_PARTS = "(coalesce(pic, 0) + coalesce(pik, 0))"
_ESTIMATE = (
    "(CASE WHEN coalesce(floor < spread, false) AND coalesce(floor > base, false) THEN floor + spread"
    " WHEN NOT coalesce(floor < spread, false) AND coalesce(floor > base + spread, false) THEN floor ELSE base + spread END)"
)
#: The rules in SQL: tag, condition, what is written, and whether the reported rate was another field.
_RATE_RULES = [
    ("fixed_spread_is_rate", "is_fixed AND rate IS NULL AND pic IS NULL AND pik IS NULL AND spread IS NOT NULL", {"rate": "spread", "spread": "NULL"}, True),
    ("rate_is_spread_floating", "NOT is_fixed AND NOT is_zero AND abs(rate - spread) <= 1e-6 AND base IS NOT NULL", {"rate": _ESTIMATE, "estimated": "true"}, True),
    ("rate_is_spread_untagged", "is_fixed IS NULL AND NOT is_zero AND abs(rate - spread) <= 1e-6 AND rate > 0.02 AND rate <= 0.09 AND base IS NOT NULL", {"rate": _ESTIMATE, "estimated": "true"}, True),
    ("clear_spread_untagged_coupon", "is_fixed IS NULL AND NOT is_zero AND abs(rate - spread) <= 1e-6 AND rate > 0.09", {"spread": "NULL"}, False),
    ("spread_is_allin_rate", f"NOT is_zero AND rate IS NULL AND (pic IS NOT NULL OR pik IS NOT NULL) AND abs(spread - {_PARTS}) <= 1e-6", {"rate": "spread", "spread": "NULL"}, True),
    ("rate_is_spread", f"NOT is_zero AND rate < pic - 1e-6 AND {_PARTS} <= 0.5", {"spread": "coalesce(spread, CASE WHEN rate > 0 THEN rate END)", "rate": _PARTS}, True),
    ("pic_is_spread", "NOT is_zero AND spread IS NULL AND pik IS NULL AND abs(rate - pic - base) <= 0.005", {"spread": "pic", "pic": "rate"}, False),
    ("rate_is_spread_components_exceed", f"NOT is_zero AND pic IS NOT NULL AND pik IS NOT NULL AND spread IS NULL AND {_PARTS} > rate + 1e-6", {"spread": "rate", "rate": _PARTS}, True),
    ("rate_is_cash_component", "NOT is_zero AND pic IS NULL AND pik > rate + 1e-6 AND rate + pik <= 0.5", {"pic": "rate", "rate": "rate + pik"}, True),
    ("rate_below_spread_replaced", "NOT is_zero AND pic IS NULL AND pik IS NULL AND rate < spread - 1e-6 AND base IS NOT NULL", {"rate": _ESTIMATE, "estimated": "true"}, False),
    ("rate_from_base_plus_spread_plus_pik", "NOT is_zero AND rate IS NULL AND pic IS NULL AND pik > spread + 1e-6 AND pik < base - 1e-6", {"rate": f"{_ESTIMATE} + pik", "pic": _ESTIMATE, "estimated": "true"}, False),
    ("rate_from_components", f"NOT is_zero AND rate IS NULL AND (pic IS NOT NULL OR pik IS NOT NULL) AND (spread IS NULL OR {_PARTS} > spread + 1e-6) AND {_PARTS} <= 0.5", {"rate": _PARTS}, False),
    ("rate_from_base_plus_spread", "NOT is_zero AND rate IS NULL AND spread IS NOT NULL AND base IS NOT NULL", {"rate": _ESTIMATE, "estimated": "true"}, False),
    ("rate_is_cash_part_of_base_plus_spread", f"NOT is_zero AND pic IS NULL AND pik > 0 AND abs(rate + pik - {_ESTIMATE}) <= 0.005 AND NOT abs(rate - {_ESTIMATE}) <= 0.005", {"pic": "rate", "rate": "rate + pik"}, True),
    ("pic_from_rate_minus_pik", "NOT is_zero AND pic IS NULL AND pik <= rate + 1e-6", {"pic": "greatest(rate - pik, 0)"}, False),
    ("pic_from_rate_minus_pik_reconcile", f"NOT is_zero AND pic IS NOT NULL AND pik IS NOT NULL AND NOT abs({_PARTS} - rate) <= 1e-6 AND pik <= rate + 1e-6", {"pic": "rate - pik"}, False),
]


def _rules_sql() -> str:
    steps, before = [], "q2"
    for i, (tag, hit, writes, moves) in enumerate(_RATE_RULES):
        new = dict(writes) | {"tags": f"CASE WHEN tags = '' THEN '{tag}' ELSE tags || '|{tag}' END"} | ({"moved": "true"} if moves else {})
        changed = ", ".join(f"CASE WHEN coalesce({hit}, false) THEN {v} ELSE {c} END AS {c}" for c, v in new.items())
        steps.append(f"s{i} AS MATERIALIZED (SELECT * REPLACE ({changed}) FROM {before})")
        before = f"s{i}"
    return ",\n".join(steps)


@query(f"""WITH q0 AS (
  SELECT l_orderkey AS row_a, l_linenumber AS row_b, CASE WHEN l_orderkey % 3 <> 0 THEN CASE WHEN l_orderkey % 5 = 0 THEN l_discount ELSE l_discount + l_tax END END AS rate,
    CASE WHEN l_orderkey % 4 <> 1 THEN l_discount END AS spread, CASE WHEN l_partkey % 3 = 0 THEN l_tax / 2 END AS pik,
    CASE WHEN l_partkey % 4 = 1 THEN l_tax + CASE WHEN l_orderkey % 7 = 0 THEN 0.03::DOUBLE ELSE 0 END END AS pic,
    CASE WHEN l_orderkey % 9 <> 0 THEN 0.051::DOUBLE - CASE WHEN l_partkey % 10 = 0 THEN 0.06::DOUBLE ELSE 0 END END AS base,
    CASE l_partkey % 6 WHEN 0 THEN 0.06::DOUBLE WHEN 1 THEN 0.01::DOUBLE END AS floor, CASE WHEN l_partkey % 5 = 0 THEN true WHEN l_partkey % 5 < 3 THEN false END AS is_fixed,
    l_partkey % 8 = 0 AS is_prime, CASE WHEN l_partkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM lineitem
),
q1 AS (
  SELECT * REPLACE (CASE WHEN base IS NOT NULL AND NOT coalesce(is_fixed, false) THEN greatest(base, 0) + CASE WHEN is_prime AND currency = 'USD' THEN 0.032::DOUBLE ELSE 0 END END AS base),
    concat_ws(', ', CASE WHEN spread IS NOT NULL THEN 'spread' END, CASE WHEN rate IS NOT NULL THEN 'rate' END, CASE WHEN pik IS NOT NULL THEN 'pik' END, CASE WHEN pic IS NOT NULL THEN 'pic' END) AS reported FROM q0
),
q2 AS (SELECT *, coalesce(rate = 0, false) AND {_PARTS} = 0 AS is_zero, false AS estimated, false AS moved, '' AS tags, rate AS rate_was FROM q1 WHERE reported <> ''),
{_rules_sql()}
SELECT row_a, row_b, reported, tags, round(rate, 8) AS rate, round(spread, 8) AS spread, round(pic, 8) AS pic, round(pik, 8) AS pik, CASE WHEN rate IS NULL THEN 'none' WHEN is_zero THEN 'zero' WHEN estimated THEN 'estimated'
  WHEN rate_was IS NOT NULL AND NOT moved THEN 'reported' ELSE 'derived' END AS rate_source, coalesce(abs(rate - {_PARTS}) <= 1e-6, false) AS check_components FROM s15""")
def resolved_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates.resolve_rates(_quoted(spark, sf_dir))
    return rounded(found.select("row_a", "row_b", "reported", "tags", "rate", "spread", "pic", "pik", "rate_source", "check_components"), 8)


_SENIORITIES = ("SENIOR_SECURED_1L", "UNITRANCHE", "SENIOR_SECURED_2L", "SUBORDINATED_MEZZ", "SENIOR_SECURED_UNSPEC", None)


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales table in the shape of filed schedules: few lenders (nations, of a region each), seniorities, terms with gaps."""
    rows = _rows(spark, sf_dir)
    seniority = F.element_at(F.array(*[F.lit(x) for x in _SENIORITIES]), (F.crc32(F.substring_index("lien", " ", 1)) % 6 + 1).cast("int"))
    return rows.withColumns(
        {
            "cik": F.col("family").cast("long"),
            "family": (F.col("family") % 5).cast("string"),
            "instrument_seniority": seniority,
            "investment_identifier": F.concat_ws(" ", "lien", F.lit("loan")),
            "maturity": F.when(F.col("row_a") % 4 != 0, F.trunc("maturity", "year")),
            "spread": F.when(F.col("row_a") % 3 != 0, F.round("spread", 2)),
        }
    )


@query()
def tranche_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("tranche", "chain_id", "link_rule", "q_gap", "xb_id", "xb_tier", "n_source_rows", "price", "pik_at_origination", "origination_censored")
    return rounded(tranches.tranche_panel(_filings(spark, sf_dir)).select(*names))


@query()
def logit_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir).where("price is not null and na_cost_share is not null and pik_share is not null")
    frame = panel.select("borrower", "qsort", "price", "pik_share", (F.col("na_cost_share") > 0.5).cast("int").alias("y"))
    return rounded(model.coefficient_table(frame, ["price", "pik_share"]))


_CUT_AT = 1996 * 4 + 2
_KNOWN = ("price", "par", "fv", "cost", "C1_families", "C4_d_families", "pik_share", "toggle_par_share", "V1_range", "max_lender_weight")


@query(f"""WITH {MONITOR_SQL}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT borrower, qsort FROM monitor WHERE qsort <= {_CUT_AT}))
SELECT unnest(['(rows)', {", ".join(repr(c) for c in _KNOWN)}]) AS "column", n AS rows_full, n AS rows_cut, 0 AS rows_differ, {_CUT_AT} AS cut_q FROM n""")
def look_ahead_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(rows: DataFrame) -> DataFrame:
        return exposure.borrower_quarters(exposure.monitor_panel(_loans(rows), rows), rows)

    found = look_ahead.compare_panels(
        _panel(spark, sf_dir).where(F.col("qsort") <= _CUT_AT), cut(build(_rows(spark, sf_dir).where(F.col("qsort") <= _CUT_AT))), ["borrower", "qsort"], list(_KNOWN)
    )
    return found.drop("max_abs_diff").withColumn("cut_q", F.lit(_CUT_AT))


def _line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as scored rows: a chance in steps, whether it happened, and a whole weight."""
    line = table(spark, sf_dir, "lineitem")
    tie = (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    happened = (F.col("l_returnflag") == "R").cast("int")
    sort = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    return line.select(tie.alias("borrower"), sort.alias("qsort"), (F.col("l_discount") * 4 + 0.05).alias("pred"), happened.alias("y"), (F.col("l_linenumber") - 1).cast("double").alias("w"))


_SCORES_SQL = """scores AS (SELECT (l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey AS borrower, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS qsort, l_discount * 4 + 0.05 AS pred,
  CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_linenumber - 1 AS DOUBLE) AS w FROM lineitem WHERE l_linenumber > 1)"""


@query(f"""WITH {_SCORES_SQL}
SELECT borrower, qsort, CAST(11 - ceil(round(sum(w) OVER (PARTITION BY qsort ORDER BY pred DESC, borrower ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY qsort) * 10, 9)) AS INT) AS decile FROM scores""")
def weighted_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.weighted_deciles(_line_scores(spark, sf_dir).where("w > 0")).select("borrower", "qsort", "decile")


@query(f"""WITH {_SCORES_SQL} SELECT qsort, sum(w * y) AS observed, round(sum(w * pred), 6) AS expected, round(sum(w * y) / sum(w * pred), 6) AS o_e, round(sum(w * (pred - y) ** 2) / sum(w), 6) AS brier,
  true AS solved FROM scores GROUP BY qsort""")
def calibration_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``solved``: at the fitted intercept and slope the weighted residuals, and those times the log odds, sum to 0, or the quarter has one outcome alone."""
    scores = _line_scores(spark, sf_dir).where("w > 0")
    found = calibration.calibration(scores, ["qsort"]).select("qsort", "observed", "expected", "o_e", "brier")
    fit = calibration.recalibrations(scores, ["qsort"], True)
    left = F.col("w") * (F.col("y") - calibration.apply_recalibration(F.col("pred"), F.col("intercept"), F.col("slope")))
    zero = lambda x: F.abs(F.sum(x)) < 1e-6 * F.sum("w")
    checked = scores.join(fit, "qsort").groupBy("qsort").agg(F.coalesce(zero(left) & zero(left * calibration.log_odds(F.col("pred"))), F.min("y") == F.max("y")).alias("solved"))
    return rounded(found.join(checked, "qsort"))


_RETURNS_SQL = "returns AS (SELECT CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS qsort, l_extendedprice * (1 - l_discount) / l_quantity AS x FROM lineitem)"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("qsort"), value.alias("x"))


@query(f"""WITH {_RETURNS_SQL}, m AS (SELECT qsort, median(x) AS med FROM returns GROUP BY qsort)
SELECT qsort, count(*) AS n, round(any_value(med), 4) AS median, round(1.4826 * median(abs(x - med)), 4) AS mad_sigma, round(skewness(x), 4) AS skew, round(kurtosis(x), 4) AS kurtosis
FROM returns JOIN m USING (qsort) GROUP BY qsort HAVING count(*) > 3""")
def robust_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tails.robust_moments(_returns(spark, sf_dir), "x", "qsort").where("n > 3"), 4)


@query(f"""WITH {_RETURNS_SQL}, q AS (SELECT DISTINCT qsort FROM returns)
SELECT q.qsort, round(quantile_cont(r.x, 0.01), 4) AS quantile FROM q JOIN returns r ON r.qsort <> q.qsort GROUP BY q.qsort""")
def quantiles_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tails.quantiles_without(_returns(spark, sf_dir), "x", "qsort", 0.01), 4)


@query(f"""WITH {EXITS_SQL},
u AS (SELECT qsort, pik, spread, maturity, 0 AS equity, write_down, 1 AS observed FROM changes WHERE linked UNION ALL SELECT exit_q, 0, 0, 0, 1, 0, 0 FROM exits WHERE equity = 1)
SELECT CAST(qsort AS INT) AS qsort, sum(pik) AS pik, sum(spread) AS spread, sum(maturity) AS maturity, sum(equity) AS equity, sum(write_down) AS write_down, sum(greatest(pik, spread, maturity, equity, write_down)) AS "any",
  sum(observed) AS loans_observed FROM u GROUP BY ROLLUP (qsort) HAVING sum(observed) > 0""")
def restructuring_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.restructuring_by_quarter(events.term_changes(_linked(spark, sf_dir)), _exits(spark, sf_dir), 10**6)
    return found.select("qsort", "pik", "spread", "maturity", "equity", "write_down", "any", "loans_observed")


_CASES = ("brand#12 promo", " Brand#13 SMALL ")


@query(f"""WITH {POSITIONS_SQL}, named AS (SELECT *, upper(borrower || ' ' || split_part(lien, ' ', 1)) AS name FROM final WHERE borrower <> 'Brand#11'),
books AS (SELECT cik, cal_q, sum(COST) AS book FROM final WHERE COST > 0 GROUP BY ALL)
SELECT name AS borrower, cal_q, cik, family, bdc_type, count(*) AS positions, max(non_accrual) AS non_accrual, round(sum(FV) / sum(PAR), 6) AS mark, round(sum(PIK_Final * PAR) / sum(PAR), 6) AS pik_rate,
  round(sum(COST) / any_value(book), 6) AS weight_in_bdc_book FROM named JOIN books USING (cik, cal_q) WHERE name IN ('BRAND#12 PROMO', 'BRAND#13 SMALL') GROUP BY ALL""")
def case_study_lenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lenders = exposure.case_studies(_panel(spark, sf_dir), _rows(spark, sf_dir), list(_CASES))
    return rounded(lenders.select("borrower", "cal_q", "cik", "family", "bdc_type", "positions", "non_accrual", "mark", "pik_rate", "weight_in_bdc_book"))


@query("""SELECT o_orderkey, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS cal_qe, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS cal_q,
  year(o_orderdate + INTERVAL 9 MONTH) || 'Q' || quarter(o_orderdate + INTERVAL 9 MONTH) AS later,
  year(o_orderdate + INTERVAL 3 MONTH) || 'Q' || quarter(o_orderdate + INTERVAL 3 MONTH) || '-' || year(o_orderdate + INTERVAL 6 MONTH) || 'Q' || quarter(o_orderdate + INTERVAL 6 MONTH) AS ahead FROM orders""")
def calendar_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quarters.add_calendar_quarter(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return found.select("o_orderkey", "cal_qe", "cal_q", quarters.q_next(F.col("cal_q"), 3).alias("later"), quarters.window_label(quarters.qsort(F.col("cal_q")), 2).alias("ahead"))
