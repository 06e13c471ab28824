import pytest
from pyspark.sql import functions as F

from quillon.operators import repair

N = None


def test_currency_codes(spark):
    rows = spark.createDataFrame([("Unit_Standard_USD_x",), ("u_eur",), ("ZNOKq",), (N,), ("GBP",)], "u string")
    assert [r[0] for r in rows.select(repair.currency_code(F.col("u"))).collect()] == ["USD", "EUR", N, N, "GBP"]


def test_conversion_and_mistagged_units(spark):
    fx = spark.createDataFrame([("2024Q1", "EUR", 0.9), ("2024Q1", "EGP", 31.0), ("2024Q1", "JPY", 150.0)], "cal_q string, currency string, per_usd double")
    rows = [
        (1, 90.0, 88.0, 89.0, "EUR", "USD", "USD"),  # a euro loan reported in dollars
        (2, 100.0, 98.0, 99.0, "EGP", "USD", "USD"),  # dollars tagged as pounds
        (3, 3.0e8, 1.9e6, 2.0e6, "USD", "USD", "USD"),  # yen tagged as dollars
        (4, 3.0e8, 1.9e6, 2.0e6, "JPY", "USD", "USD"),
        (5, 10.0, N, 9.0, N, N, "EUR"),
    ]
    frame = spark.createDataFrame(rows, "i int, PAR double, FV double, COST double, PAR_unit string, FV_unit string, COST_unit string").withColumn("cal_q", F.lit("2024Q1"))
    got = {r.i: (round(r.PAR_usd, 2), r.currency, r.unit_mismatch_fixed) for r in repair.convert_currencies(frame, fx).collect()}
    assert got == {1: (100.0, "EUR", False), 2: (100.0, "USD", True), 3: (2.0e6, "JPY", True), 4: (2.0e6, "JPY", False), 5: (10.0, "EUR", False)}


def test_rate_types(spark):
    rows = [("http://x#FixedRateMember", "a"), ("y#PrimeRateMember", "b"), (N, "Loan, Prime + 1.35%"), (N, "Prime Time LLC"), ("z#SOFRMember", "c")]
    got = repair.rate_type(spark.createDataFrame(rows, "rate_type_uri string, investment_identifier string")).collect()
    assert [(r.RateType, r.is_fixed, r.is_prime) for r in got] == [("FixedRateMember", True, False), ("PrimeRateMember", False, True), (N, N, True), (N, N, False), ("SOFRMember", False, False)]


def test_component_scale(spark):
    rows = spark.createDataFrame([(0.12, N, 0.5, 0.5), (0.0896, N, N, 0.48), (N, 0.05, 0.3, N), (0.1, N, 0.05, 0.05)], "rate double, spread double, pic double, pik double")
    got = [(r.pic, r.pik) for r in repair.fix_component_scale(rows).collect()]
    assert got[0] == (0.06, 0.06) and got[1] == (N, pytest.approx(0.0048)) and got[2] == (pytest.approx(0.003), N) and got[3] == (0.05, 0.05)


def test_units_signs_and_gaps(spark):
    rows = [("A preferred units", 4570.0, 10.0, 9.0), ("B term loan", 4570.0, 10.0, 9.0), ("C", 1.0, 10.0, 11.0), ("D", 10.0, -9.0, 9.5), ("E", 10.0, -9.0, -9.5), ("F", 10.0, -0.2, 9.0), ("G", 10.0, 9.0, 40.0), ("H", N, 5.0, 5.0)]
    frame = spark.createDataFrame(rows, "investment_identifier string, PAR double, COST double, FV double")
    got = {r.investment_identifier[0]: r for r in repair.fix_signs(repair.cap_unit_principals(frame)).withColumn("gap", repair.value_gap(F.col("PAR"), F.col("COST"), F.col("FV"))).collect()}
    assert (got["A"].PAR, got["A"].unit_flag, got["B"].PAR, got["C"].PAR, got["C"].unit_flag) == (10.0, "equity_units_capped", 4570.0, 10.0, "units_as_principal")
    assert [(got[k].COST, got[k].FV, got[k].sign_flag) for k in "DEF"] == [(9.0, 9.5, "cost"), (9.0, 9.5, "cost and value"), (-0.2, 9.0, N)]
    assert [got[k].gap for k in "ABFGH"] == ["consistent", "principal_high|fv_cost", "na", "fv_high", "na"]


def test_median_of_the_others(spark):
    rows = [("a", i, v) for i, v in enumerate([5.0, 1.0, 9.0, 3.0])] + [("b", 0, 7.0), ("c", 0, 1.0), ("c", 1, 1.0)]
    got = {(r.g, r.i): r.m for r in repair.others_median(spark.createDataFrame(rows, "g string, i int, v double"), "g", "v", "m").collect()}
    assert [got["a", i] for i in range(4)] == [3.0, 5.0, 3.0, 5.0] and got["b", 0] is None and got["c", 0] == 1.0


def test_filer_quarters_out_of_scale(spark):
    rows = [(1, f"2024Q{q}", 1e6 if q != 3 else x, 1.0, 1.0) for q in (1, 2, 3, 4) for x in (1e9, 4e5)] + [(2, "2024Q1", 1e9, 1.0, 1.0), (2, "2024Q2", 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "cik int, cal_q string, FV double, PAR double, COST double")
    flagged = {(r.cik, r.cal_q) for r in repair.filer_quarter_outliers(frame).where("outlier").collect()}
    assert flagged == {(1, "2024Q3")}
    assert sorted((r.FV, r.PAR) for r in repair.rescale_filer_quarters(frame).where("rescaled").collect()) == [(1e6, 1e-3)]


def test_subtotals(spark):
    rows = [(1, "x", "Debt Securities", 210.0)] + [(1, "x", f"Debt Securities - Company {i}", 10.0) for i in range(21)]
    rows += [(1, "x", "Vision, Inc.", 20.0), (1, "x", "Vision, Inc., JV", 20.0), (2, "x", "Debt Securities", 210.0), (1, "x", "Debt Securitiesx", 1.0), (1, "x", N, 1.0)]
    frame = spark.createDataFrame(rows, "cik int, accession string, investment_identifier string, FV double")
    left = repair.drop_subtotals(frame).collect()
    assert len(left) == len(rows) - 1 and not any(r.cik == 1 and r.investment_identifier == "Debt Securities" for r in left)


def test_overrides_and_contexts(spark):
    rows = spark.createDataFrame([("a", "1", 1.0, 2.0, 3.0, N), ("a", "2", 1.0, N, N, 0.1)], "accession string, context_id string, PAR double, FV double, COST double, rate double")
    fixes = spark.createDataFrame([("a", "1", "FV", 1000.0, N), ("a", "1", "PAR", N, 5.0)], "accession string, context_id string, column string, factor double, value double")
    got = repair.manual_overrides(rows, fixes).orderBy("context_id").collect()
    assert [(r.PAR, r.FV, r.COST) for r in got] == [(5.0, 2000.0, 3.0), (1.0, N, N)]
    kinds = rows.select(repair.classify_context(rows, ("rate",), ("FV", "COST"))).collect()
    assert [r[0] for r in kinds] == ["amounts_only", "terms_only"]
