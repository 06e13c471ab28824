"""Queries over repairs of amounts, tranches and texts, on the sales tables with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.lineage import cut
from quillon.functions.quarters import q_label
from quillon.functions.text import cleaned_identifier, keyword_dates, seniority
from quillon.operators import repair, tranches

from .proxy import table
from .registry import query, rounded

_FAULTY_SQL = """faulty AS (
  SELECT l_orderkey AS row_a, l_linenumber AS row_b, l_partkey AS row_c, l_suppkey AS cik, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS cal_q,
    CASE WHEN l_orderkey % 7 = 0 THEN 'Common Stock ' ELSE 'Term Loan ' END || l_partkey AS ident,
    1.000037 * l_extendedprice * (CASE WHEN l_orderkey % 14 = 0 THEN 500 WHEN l_orderkey % 10 = 0 THEN 0.2 ELSE 1 END) AS PAR,
    1.000037 * l_extendedprice * (1 - l_discount / 2) * (CASE WHEN l_orderkey % 5 = 0 AND l_linenumber < 3 THEN -1 ELSE 1 END) AS COST,
    1.000037 * l_extendedprice * (1 - l_discount) * (CASE WHEN l_orderkey % 15 = 0 AND l_linenumber = 1 THEN -1 WHEN l_orderkey % 11 = 0 THEN 9 ELSE 1 END) AS FV,
    CASE WHEN l_orderkey % 3 > 0 THEN l_tax + l_discount END AS rate, CASE WHEN l_orderkey % 4 > 0 THEN l_discount END AS spread,
    CASE WHEN l_orderkey % 6 = 0 THEN 0.5 WHEN l_orderkey % 13 = 0 THEN l_tax * 100 ELSE l_tax END AS pic, CASE WHEN l_orderkey % 6 = 0 THEN 0.5 ELSE l_discount END AS pik
  FROM lineitem)"""


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    key, number, price = F.col("l_orderkey"), F.col("l_linenumber"), F.lit(1.000037) * F.col("l_extendedprice")
    return line.select(
        key.alias("row_a"),
        number.alias("row_b"),
        F.col("l_partkey").alias("row_c"),
        F.col("l_suppkey").alias("cik"),
        (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("cal_q"),
        F.concat(F.when(key % 7 == 0, "Common Stock ").otherwise("Term Loan "), F.col("l_partkey").cast("string")).alias("investment_identifier"),
        (price * F.when(key % 14 == 0, 500.0).when(key % 10 == 0, 0.2).otherwise(1.0)).alias("PAR"),
        (price * (1 - F.col("l_discount") / 2) * F.when((key % 5 == 0) & (number < 3), -1.0).otherwise(1.0)).alias("COST"),
        (price * (1 - F.col("l_discount")) * F.when((key % 15 == 0) & (number == 1), -1.0).when(key % 11 == 0, 9.0).otherwise(1.0)).alias("FV"),
        F.when(key % 3 > 0, F.col("l_tax") + F.col("l_discount")).alias("rate"),
        F.when(key % 4 > 0, F.col("l_discount")).alias("spread"),
        F.when(key % 6 == 0, 0.5).when(key % 13 == 0, F.col("l_tax") * 100).otherwise(F.col("l_tax")).alias("pic"),
        F.when(key % 6 == 0, 0.5).otherwise(F.col("l_discount")).alias("pik"),
    )


def _agree(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0) BETWEEN 0.5 AND 2, false)"


@query(f"""WITH {_FAULTY_SQL},
s1 AS (SELECT *, ident LIKE 'Common Stock%' AND coalesce(COST > 0 AND PAR > 100 * COST, false) AS many FROM faulty),
s2 AS (SELECT * REPLACE (CASE WHEN many THEN COST ELSE PAR END AS PAR) FROM s1),
s3 AS (SELECT *, coalesce(PAR > 0 AND COST > 3 * PAR, false) AND {_agree("FV", "COST")} AS few FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN few THEN COST ELSE PAR END AS PAR), CASE WHEN many THEN 'equity_units_capped' WHEN few THEN 'units_as_principal' END AS unit_flag FROM s3),
s5 AS (SELECT *, coalesce(COST < 0 AND PAR > 0, false) AND {_agree("-COST", "PAR")} AS funded FROM s4),
s6 AS (SELECT *, CASE WHEN funded AND FV > 0 AND {_agree("-COST", "FV")} THEN 'cost' WHEN funded AND FV < 0 AND {_agree("-FV", "PAR")} THEN 'cost and value' END AS sign_flag FROM s5),
s7 AS (SELECT * REPLACE (CASE WHEN sign_flag IS NOT NULL THEN -COST ELSE COST END AS COST, CASE WHEN sign_flag = 'cost and value' THEN -FV ELSE FV END AS FV) FROM s6)
SELECT row_a, row_b, row_c, round(PAR, 4) AS PAR, round(COST, 4) AS COST, round(FV, 4) AS FV, unit_flag, sign_flag,
  CASE WHEN NOT coalesce(PAR > 0 AND COST > 0, false) THEN 'na' WHEN PAR > 3 * COST THEN 'principal_high|' || CASE WHEN {_agree("FV", "COST")} THEN 'fv_cost' WHEN {_agree("FV", "PAR")} THEN 'fv_principal' ELSE 'fv_neither' END
    WHEN COST > 3 * PAR THEN 'cost_high' WHEN FV > 3 * COST AND FV > 3 * PAR THEN 'fv_high' ELSE 'consistent' END AS gap FROM s7""")
def amount_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.fix_signs(repair.cap_unit_principals(_faulty(spark, sf_dir)))
    gap = repair.value_gap(F.col("PAR"), F.col("COST"), F.col("FV")).alias("gap")
    return rounded(rows.select("row_a", "row_b", "row_c", "PAR", "COST", "FV", "unit_flag", "sign_flag", gap), 4)


_HALF = "coalesce(abs(pic - 0.5) <= 1e-6, false) AND coalesce(abs(pik - 0.5) <= 1e-6, false) AND coalesce(rate BETWEEN 0 AND 0.25, false)"


def _small_sql(c: str) -> str:
    return f"CASE WHEN coalesce({c} > 0.2 AND {c} > ref + 0.1 AND {c} / 100 <= ref, false) THEN {c} / 100 ELSE {c} END"


@query(f"""WITH {_FAULTY_SQL},
h AS (SELECT *, {_HALF} AS half, coalesce(rate, spread + 0.06) AS ref FROM faulty),
s AS (SELECT * REPLACE (CASE WHEN half THEN rate / 2 ELSE pic END AS pic, CASE WHEN half THEN rate / 2 ELSE pik END AS pik) FROM h)
SELECT row_a, row_b, row_c, round({_small_sql("pic")}, 6) AS pic, round({_small_sql("pik")}, 6) AS pik FROM s""")
def component_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(repair.fix_component_scale(_faulty(spark, sf_dir)).select("row_a", "row_b", "row_c", "pic", "pik"))


@query(f"""WITH {_FAULTY_SQL},
amounts AS (SELECT *, CASE WHEN cik % 10 = 3 AND cal_q = 7980 THEN 1000 ELSE 1 END AS k FROM faulty),
scaled AS (SELECT row_a, row_b, row_c, cik, cal_q, PAR * k AS PAR, COST * k AS COST, FV * k AS FV FROM amounts),
totals AS (SELECT cik, cal_q, sum(abs(FV)) AS total FROM scaled GROUP BY ALL),
others AS (SELECT a.cik, a.cal_q, any_value(a.total) AS total, median(b.total) AS med, count(b.total) AS n FROM totals a LEFT JOIN totals b ON a.cik = b.cik AND a.cal_q <> b.cal_q GROUP BY ALL),
hit AS (SELECT s.*, n > 1 AND med > 0 AND total > 20 * med AND abs(FV) > 0.25 * med AS r FROM scaled s JOIN others USING (cik, cal_q))
SELECT row_a, row_b, row_c, coalesce(r, false) AS rescaled, round(PAR / CASE WHEN r THEN 1000 ELSE 1 END, 4) AS PAR, round(FV / CASE WHEN r THEN 1000 ELSE 1 END, 4) AS FV FROM hit""")
def filer_quarter_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faulty(spark, sf_dir)
    factor = F.when((F.col("cik") % 10 == 3) & (F.col("cal_q") == 7980), 1000.0).otherwise(1.0)
    rows = rows.withColumns({c: F.col(c) * factor for c in ("PAR", "COST", "FV")})
    return rounded(repair.rescale_filer_quarters(rows).select("row_a", "row_b", "row_c", "rescaled", "PAR", "FV"), 4)


_LIENS = ("First Lien Term Loan", "2nd-lien: Second Lien", "Unsecured note", "Senior Secured", "Holdco Notes", "CLO equity", "Unitranche", "Equity")
_SENIORITIES = ("SENIOR_SECURED_1L", "SENIOR_SECURED_2L", "SENIOR_UNSECURED", "SENIOR_SECURED_UNSPEC", "SUBORDINATED_MEZZ", "CLO_STRUCTURED_EQUITY", "UNITRANCHE", "OTHER_UNKNOWN")


@query(f"""SELECT p_partkey, list_extract([{", ".join(repr(s) for s in _SENIORITIES)}], p_partkey % 8 + 1) AS seniority,
  trim(regexp_replace(lower(list_extract([{", ".join(repr(s) for s in _LIENS)}], p_partkey % 8 + 1) || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) AS cleaned,
  make_date(2020 + p_partkey % 10, 1 + p_partkey % 12, 15) AS due FROM part""")
def identifier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    text = F.concat(F.get(F.array(*[F.lit(x) for x in _LIENS]), (key % 8).cast("int")), F.lit(" ("), "p_brand", F.lit(")"))
    due = F.concat(text, F.lit(", 1/2/2019, due "), (1 + key % 12).cast("string"), F.lit("/"), (2020 + key % 10).cast("string"))
    return part.select("p_partkey", seniority(text).alias("seniority"), cleaned_identifier(text).alias("cleaned"), keyword_dates(due)[0].alias("due"))


_SENIOR = ("SENIOR_SECURED_1L", "SENIOR_SECURED_2L", "OTHER_UNKNOWN")
_FUNDED_SQL = """funded AS (
  SELECT l_suppkey % 25 AS cik, 'B' || l_partkey % 40 AS borrower_key, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS qsort, list_extract(['SENIOR_SECURED_1L', 'SENIOR_SECURED_2L', 'OTHER_UNKNOWN'], l_partkey % 3 + 1) AS lien,
    CASE WHEN l_orderkey % 4 > 0 THEN make_date(2025 + l_orderkey % 3, 1, 1) END AS maturity, CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber / 100 END AS spread,
    1.000037 * l_extendedprice AS PAR, 1.000037 * l_extendedprice * (1 - l_discount / 2) * (CASE WHEN l_quantity < 4 THEN 0.03 WHEN l_quantity < 9 THEN 0.5 ELSE 1 END) AS COST, 1.000037 * l_extendedprice * (1 - l_discount) AS FV, l_tax AS PIK_Final
  FROM lineitem)"""


def _debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    price, quantity = F.lit(1.000037) * F.col("l_extendedprice"), F.col("l_quantity")
    return line.select(
        (F.col("l_suppkey") % 25).alias("cik"),
        F.lit("F").alias("family"),
        q_label(F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("cal_q"),
        F.concat(F.lit(" B"), (F.col("l_partkey") % 40).cast("string"), F.lit(" ")).alias("borrower_canonical"),
        F.get(F.array(*[F.lit(s) for s in _SENIOR]), (F.col("l_partkey") % 3).cast("int")).alias("instrument_seniority"),
        F.lit("loan").alias("investment_identifier"),
        F.when(F.col("l_orderkey") % 4 > 0, F.concat((2025 + F.col("l_orderkey") % 3).cast("string"), F.lit("-01-01T00:00"))).alias("maturity"),
        F.when(F.col("l_orderkey") % 5 > 0, (F.col("l_linenumber") / 100).cast("string")).alias("spread"),
        price.alias("PAR"),
        (price * (1 - F.col("l_discount") / 2) * F.when(quantity < 4, 0.03).when(quantity < 9, 0.5).otherwise(1.0)).alias("COST"),
        (price * (1 - F.col("l_discount"))).alias("FV"),
        F.col("l_tax").alias("PIK_Final"),
    )


_TRANCHE_SQL = f"""{_FUNDED_SQL}, kept AS (SELECT * FROM funded WHERE FV > 0 AND COST > 0 AND COST >= 0.05 * PAR),
tranches AS (
  SELECT cik, borrower_key, qsort, lien, maturity, round(spread, 4) AS spread, sum(PAR) AS PAR, sum(COST) AS COST, sum(FV) AS FV, sum(FV) FILTER (COST >= 0.8 * PAR) / sum(PAR) FILTER (COST >= 0.8 * PAR) AS price,
    sum(PAR * PIK_Final) / sum(PAR) AS PIK_Final, count(*) AS n_source_rows FROM kept GROUP BY ALL)"""


@query(f"WITH {_TRANCHE_SQL} SELECT cik, borrower_key, qsort, lien, maturity, spread, round(PAR, 4) AS PAR, round(COST, 4) AS COST, round(FV, 4) AS FV, round(price, 6) AS price, round(PIK_Final, 6) AS PIK_Final, n_source_rows FROM tranches")
def collapsed_tranches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tranches.collapse_tranches(tranches.standardize_debt_rows(_debt(spark, sf_dir)))
    amounts = [F.round(c, 4).alias(c) for c in ("PAR", "COST", "FV")]
    return found.select("cik", "borrower_key", "qsort", "lien", "maturity", "spread", *amounts, F.round("price", 6).alias("price"), F.round("PIK_Final", 6).alias("PIK_Final"), "n_source_rows")


@query(f"""WITH {_TRANCHE_SQL}
SELECT count(*) AS tranches, true AS one_to_one, true AS liens_fit, true AS gaps_fit, true AS chains_fit, true AS no_pair_left FROM tranches""")
def chain_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for links of tranches whatever the choice: each takes part once on either side, liens fit, gaps are two quarters at most, a chain has one
    start and a tranche a quarter at most, and no two tranches stay unlinked that would be the last of both sides."""
    base = cut(tranches.collapse_tranches(tranches.standardize_debt_rows(_debt(spark, sf_dir))))
    linked = cut(tranches.link_tranche_chains(base))
    chains = linked.groupBy("chain_id").agg(F.count("*").alias("n"), F.count_distinct("qsort").alias("quarters"), F.count_if(F.col("link_rule") == 0).alias("starts"))
    chains = chains.agg(F.bool_and((F.col("n") == F.col("quarters")) & (F.col("starts") == 1)).alias("chains_fit"))
    by_time = Window.partitionBy("chain_id").orderBy("qsort")
    steps = linked.withColumns({"before": F.lag("qsort").over(by_time), "lien_before": F.lag("lien_group").over(by_time)})
    fits = steps.agg(
        F.count("*").alias("tranches"),
        F.bool_and(F.col("before").isNull() == (F.col("link_rule") == 0)).alias("one_to_one"),
        F.bool_and(F.col("lien_before").isNull() | tranches.compatible(F.col("lien_before"), F.col("lien_group"))).alias("liens_fit"),
        F.bool_and(F.col("before").isNull() | ((F.col("qsort") - F.col("before") == F.col("q_gap")) & (F.col("q_gap") <= 2))).alias("gaps_fit"),
    )
    # Per lender, borrower and step between quarters: tranches without a link onward and without one back.
    loan = ["cik", "borrower_key"]
    quarters = linked.select(*loan, "qsort").distinct().withColumn("following", F.lead("qsort").over(Window.partitionBy(*loan).orderBy("qsort")))
    ends = steps.withColumn("onward", F.lead("qsort").over(by_time)).join(quarters, [*loan, "qsort"])
    open_ends = ends.where("onward IS NULL AND following - qsort <= 2").groupBy(*loan, F.col("following").alias("qsort")).agg(F.count("*").alias("a"), F.max("lien_group").alias("la"))
    open_starts = ends.where("before IS NULL").groupBy(*loan, "qsort").agg(F.count("*").alias("b"), F.max("lien_group").alias("lb"))
    by_par = ends.where("link_rule = 4").select(*loan, "qsort").distinct()  # a pair by par: two or more were left when terms were done
    left = open_ends.join(open_starts, [*loan, "qsort"]).join(by_par, [*loan, "qsort"], "left_anti").where("a = 1 AND b = 1").where(tranches.compatible(F.col("la"), F.col("lb")))
    return fits.crossJoin(chains).crossJoin(left.agg((F.count("*") == 0).alias("no_pair_left")))  # one row each
