"""A loan panel in the shape of filings, mapped from the generic sales tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.quarters import q_label, qsort_of_date


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan rows: lender, family, borrower, lien, quarter, amounts, rates with gaps, and tri-state status."""
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("family"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("borrower"), F.col("p_type").alias("lien"))
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    pik = F.when(F.col("l_returnflag") == "R", discount)
    total = F.when(F.col("l_linestatus") == "F", tax + discount)
    cash = F.when(F.col("l_returnflag") != "A", tax)
    sort = qsort_of_date(F.col("l_shipdate"))
    return (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("row_a"),
            F.col("l_linenumber").alias("row_b"),
            F.col("l_suppkey").alias("cik"),
            "family",
            "borrower",
            "lien",
            sort.alias("qsort"),
            q_label(sort).alias("cal_q"),
            price.alias("PAR"),
            (price * (1 - discount)).alias("FV"),
            (price * (1 - discount / 2)).alias("COST"),
            cash.alias("rate_cash"),
            pik.alias("rate_pik"),
            total.alias("interest_rate"),
            F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("non_accrual"),
            (discount / 2).alias("spread"),
            (F.col("l_quantity") > 5).alias("price_ok"),
            F.date_add(F.lit("2000-01-01").cast("date"), (F.col("l_partkey") % 2000).cast("int")).alias("maturity"),
            F.element_at(F.array(F.lit("public"), F.lit("private"), F.lit(None)), F.col("l_suppkey").cast("int") % 3 + 1).alias("bdc_type"),
        )
    )


#: The same rows in SQL, as the start of a WITH clause.
POSITIONS_SQL = """
pos AS (
  SELECT l_orderkey AS row_a, l_linenumber AS row_b, l_suppkey AS cik, s_nationkey AS family, p_brand AS borrower, p_type AS lien,
    CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS qsort,
    CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS cal_q,
    l_extendedprice AS PAR, l_extendedprice * (1 - l_discount) AS FV, l_extendedprice * (1 - l_discount / 2) AS COST,
    CASE WHEN l_returnflag <> 'A' THEN l_tax END AS rate_cash,
    CASE WHEN l_returnflag = 'R' THEN l_discount END AS rate_pik,
    CASE WHEN l_linestatus = 'F' THEN l_tax + l_discount END AS interest_rate,
    CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS non_accrual,
    l_discount / 2 AS spread, l_quantity > 5 AS price_ok, DATE '2000-01-01' + CAST(l_partkey % 2000 AS INT) AS maturity, CASE l_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' END AS bdc_type
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
),
rated AS (
  SELECT *, (CASE WHEN rate_cash IS NULL THEN 1 ELSE 0 END + CASE WHEN rate_pik IS NULL THEN 1 ELSE 0 END
    + CASE WHEN interest_rate IS NULL THEN 1 ELSE 0 END) AS n_missing FROM pos
),
final AS (
  SELECT *, PIC_Final + PIK_Final AS IR_Final FROM (
    SELECT *, CASE WHEN rate_cash IS NOT NULL THEN rate_cash WHEN n_missing = 1 THEN interest_rate - rate_pik
        WHEN interest_rate IS NOT NULL AND rate_pik IS NULL THEN interest_rate ELSE 0 END AS PIC_Final,
      CASE WHEN rate_pik IS NOT NULL THEN rate_pik WHEN n_missing = 1 THEN interest_rate - rate_cash ELSE 0 END AS PIK_Final
    FROM rated WHERE n_missing < 3)
)"""
