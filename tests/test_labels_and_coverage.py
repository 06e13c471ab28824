"""Labels, nearest quarters, tables of different columns and scales: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import lineage
from quillon.operators import coverage, labels, scales, widening


@pytest.mark.parametrize(
    "text,want",
    [("Acme Dental Software", "Healthcare"), ("Cloud bank", "Technology"), ("First Bank Airlines", "Financials & Insurance"), ("Café Hotel", "Consumer"), ("CLO Subordinated Notes, healthcare", "Financials & Insurance"),
     ("manufacturing", "Other / Unknown"), ("", "Other / Unknown"), (None, "Other / Unknown"), ("Oil & Gas", "Energy & Utilities")],
)
def test_first_pattern_wins(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(labels.sector(F.col("t"))).first()[0] == want


def test_report_sectors_vote(spark):
    rows = [
        ("a", "X", "Technology", "Software", 3), ("b", "X", "Technology", "Hardware", 2), ("c", "X", "Technology", None, 1), ("d", "X", "Industrials", "Freight logistics consulting", 1),
        ("e", "", "Technology", "Hardware (other BDC)", 9), ("f", None, "Industrials", "staffing", 0), ("g", "X", "Materials", "software", 5), ("h", "Y", "Industrials", "Staffing (sibling rows)", None),
    ]
    got = {r[0]: r[1] for r in labels.report_sectors(spark.createDataFrame(rows, "investment_identifier string, borrower string, sector string, evidence string, rows int")).collect()}
    assert got == {
        "a": "Software", "b": "Software", "c": "Software", "d": "Industrials (ex-business services)", "e": "Technology (ex-software)", "f": "Business Services", "g": "Materials", "h": "Business Services"
    }


def test_families(spark):
    rows = [(1, "Old Fund", "2010"), (1, "OFS Capital Corp", "2012"), (2, "Plain LLC", "2010"), (2, " Plain LLC ", "2015"), (2, "Renamed", "2013"), (1414932, "Fifth Elm", "2010"), (3, None, "2010"), (4, "Prospect of Apollo", "2010")]
    found = labels.families(spark.createDataFrame(rows, "cik long, company string, date string"))
    assert {r.cik: r.family for r in found.collect()} == {1: "OFS", 2: "Renamed", 1414932: "Oaktree", 3: "3", 4: "Apollo"}
    lenders = spark.createDataFrame([("1",), ("77",), (None,)], "cik string")
    assert sorted(map(str, (r.family for r in labels.add_family(lenders, found).collect()))) == ["77", "None", "OFS"]
    names = spark.createDataFrame([(9, "FS KKR Capital Corp"), (9, "Some Owl Rock"), (9, "Unruly Fund"), (9, None)], "cik long, name string")
    assert [r[0] for r in names.select(labels.manager(F.col("cik"), F.col("name"))).collect()] == ["FS KKR", "Blue Owl", "Unruly Fund", "9"]


def test_nearest_quarter_equals_brute_force(spark):
    rng = random.Random(2)
    known = [(k, q, rng.random()) for k in range(6) for q in range(40) if k != 3 and rng.random() < 0.2]
    asked = [(rng.randrange(7), rng.randrange(-5, 45), i) for i in range(200)] + [(None, 4, 900)]
    got = coverage.nearest_quarter(spark.createDataFrame(asked, "k int, q int, i int"), spark.createDataFrame(known, "k int, q int, v double"), ["k"], "q", ["v"])
    want = {i: min(((abs(q - kq), kq, v) for kk, kq, v in known if kk == k), default=(0, 0, None))[2] for k, q, i in asked}
    assert {r.i: r.v for r in got.collect()} == want


def test_frames_of_different_columns(spark):
    rng = random.Random(5)
    frames, rows = [], []
    for i in range(50):
        columns = rng.sample([f"ns{j}:c{j % 7}" for j in range(14)], 4)
        data = [(str(i), f"acc{i}", f"c{k}", *(f"{i}-{k}-{c}" for c in columns)) for k in range(3)]
        frames.append(spark.createDataFrame(data, ["cik", "accession", "context_id", *columns]))
        rows += [dict(zip(["cik", "accession", "context_id", *columns], d, strict=True)) for d in data]
    first = widening.append_batch(None, frames[:20])
    table = widening.append_batch(first, [*frames[20:], frames[49]])
    assert table.columns[: len(first.columns)] == first.columns and widening.append_batch(table, []) is table
    got = [{k: v for k, v in r.asDict().items() if v is not None} for r in table.collect()]
    assert sorted(map(str, map(sorted, map(dict.items, got)))) == sorted(map(str, map(sorted, map(dict.items, rows))))
    merged = widening.merge_prefixes(table)
    assert set(merged.columns) == {"cik", "accession", "context_id", *(f"c{i}" for i in range(7))}
    filings = spark.createDataFrame([("7", "acc7"), ("700", "acc7")], "cik string, accession string")
    assert [tuple(r) for r in widening.not_parsed(filings, table).collect()] == [("700", "acc7")]
    full = {r.column: (r.non_null_count, r.percentage) for r in widening.fullness(frames[0].withColumn("x-unitRef", F.lit(1))).collect()}
    assert full["cik"] == (3, 100.0) and "x-unitRef" not in full


def test_filing_that_tags_principals_in_thousands(spark):
    """Its values are in line with the lender's other quarters, so the principals are wrong, those of part-drawn loans too."""
    rows = [(1, f"a{q}", f"2024Q{q}", f"p{i}", 90.0 * i, 95.0 * i, 100.0 * i * (0.001 if q == 2 else 1)) for q in (1, 2, 3) for i in range(1, 9)]
    rows += [(1, "a2", "2024Q2", "drawn", 4.0, 4.0, 0.4), (1, "a2", "2024Q2", "right", 50.0, 50.0, 51.0), (1, "a2", "2024Q2", "unfunded", 0.0, 0.0, 0.3), (1, "a2", "2024Q2", "none", 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "cik int, accession string, cal_q string, investment_identifier string, FV double, COST double, PAR double")
    got = {(r.accession, r.investment_identifier): (r.PAR, r.filing_flag) for r in scales.filing_principal_scale(df).collect()}
    assert got["a2", "p3"] == (pytest.approx(300.0), "filing_mul1000") and got["a1", "p3"] == (300.0, None)
    assert got["a2", "drawn"] == (pytest.approx(400.0), "filing_mul1000") and got["a2", "right"] == (51.0, None)
    assert got["a2", "unfunded"] == (pytest.approx(300.0), "filing_mul1000") and got["a2", "none"] == (None, None)
    grown = df.withColumns({"FV": F.when(F.col("cal_q") == "2024Q2", F.col("FV") * 1000).otherwise(F.col("FV")), "COST": F.when(F.col("cal_q") == "2024Q2", F.col("COST") * 1000).otherwise(F.col("COST"))})
    assert scales.filing_principal_scale(grown).where("filing_flag is not null").count() == 0  # values, not principals, are off


def test_rows_against_their_principal_and_history(spark):
    rows = [
        (1, "a", "2024Q1", "values", 1.9e6, 2.0e6, 2000.0), (1, "b", "2024Q2", "principal", 1.9e6, 2.0e6, 2000.0), (1, "c", "2024Q3", "principal", 1.9e6, 2.0e6, 2.0e6),
        (1, "d", "2024Q4", "high", 1.9e6, 2.0e6, 2.1e9), (1, "d", "2024Q4", "equity", 10.0, 500.0, 5.0e5), (1, "e", "2025Q1", "small value", 2000.0, 2.0e6, 2.1e6),
        (1, "e", "2025Q1", "zero", 5.0, 5.0, 0.0), (1, "e", "2025Q1", "missing", 5.0, None, None), (1, "e", "2025Q1", "far", 5.0e9, 5.0, 10.0),
    ]
    rows += [(1, a, q, f"sane {a}{i}", 1e5, 1e5, 1e5) for a, q in {(r[1], r[2]) for r in rows} for i in range(7)]  # no filing votes
    df = spark.createDataFrame(rows, "cik int, accession string, cal_q string, investment_identifier string, FV double, COST double, PAR double")
    got = {(r.investment_identifier, r.accession): r for r in scales.value_scales(df).collect()}
    assert (got["values", "a"].FV, got["values", "a"].PAR_scale_flag, got["values", "a"].FV_scale_flag) == (1900.0, "unchanged", "div1000")
    assert (got["principal", "b"].PAR, got["principal", "b"].PAR_scale_flag, got["principal", "b"].FV) == (2.0e6, "mul1000", 1.9e6)
    assert (got["high", "d"].PAR, got["high", "d"].PAR_scale_flag) == (2.1e6, "div1000") and got["equity", "d"].PAR == 5.0e5
    assert (got["small value", "e"].FV, got["small value", "e"].FV_scale_flag) == (2.0e6, "mul1000")
    assert got["zero", "e"].FV_scale_flag == "na" and got["missing", "e"].PAR_scale_flag == "na" and got["far", "e"].FV_scale_flag == "unresolved"


def test_kept_tables_are_made_once(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(3).toDF("x")

    assert [lineage.kept(spark, ("t", 1), build).count() for _ in range(3)] == [3, 3, 3] and len(made) == 1
    assert lineage.kept(spark, ("t", 2), build).count() == 3 and len(made) == 2
