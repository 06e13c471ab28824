import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.sources import rate_files as files

D = dt.date


def each(spark, values, make):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(make(F.col("v"))).collect()]


def test_borrower_names(spark):
    names = ["Project Alpha Intermediate Holding, Inc.", "Société Générale S.A.", "Müller GmbH & Co. KG", "J.P. Foods L.L.C.", "Inc Research", "Wings 'N More, LLC Holdings", "Co", None]
    assert each(spark, names, text.borrower_name_plain) == ["PROJECT ALPHA INTERMEDIATE HOLDING", "SOCIETE GENERALE", "MULLER", "JP FOODS", "INC RESEARCH", "WINGS N MORE HOLDINGS", "CO", None]


@pytest.mark.parametrize(
    ("description", "label"),
    [
        ("First Lien Senior Secured", "SENIOR_SECURED_1L"), ("2nd lien term loan", "SENIOR_SECURED_2L"), ("Unsecured notes", "SENIOR_UNSECURED"), ("Senior Notes due 2030", "SENIOR_UNSECURED"),
        ("Senior secured notes", "SENIOR_SECURED_UNSPEC"), ("Unitranche first lien", "UNITRANCHE"), ("Mezzanine", "SUBORDINATED_MEZZ"), ("CLO Subordinated Notes", "CLO_STRUCTURED_EQUITY"),
        ("Structured Finance - Membership Interests", "CLO_STRUCTURED_EQUITY"), ("Common stock", "OTHER_UNKNOWN"), (None, "OTHER_UNKNOWN"), ("Junior secured", "SENIOR_SECURED_2L"),
    ],
)
def test_seniority(spark, description, label):
    assert each(spark, [description], text.seniority) == [label]


def test_dates_in_cells(spark):
    cells = ["due 5/7/2027", "12/2028", "Mar. 5, 2029 and June 2030", "2031-02-28", "5/7/27", "13/45/2020", "1/2/3456", "none", "02/30/2025"]
    got = each(spark, cells, text.find_dates)
    assert got == [[D(2027, 5, 7)], [D(2028, 12, 15)], [D(2029, 3, 5), D(2030, 6, 15)], [D(2031, 2, 28)], [D(2027, 5, 7)], [], [], [], []]
    assert each(spark, ["11/26", "x 11/26", "11/2026"], text.cell_dates) == [[D(2026, 11, 15)], [], [D(2026, 11, 15)]]
    assert each(spark, ["Term (S + 10%, Due 11/2026) bought 1/2/2020", "bought 1/2/2020", "Maturity Date: 6/30/2030"], text.keyword_dates) == [[D(2026, 11, 15)], [], [D(2030, 6, 30)]]


def test_small_texts(spark):
    assert each(spark, ["<td> A&amp;B&nbsp;<b>x</b>\n y</td>"], text.plain_text) == ["A&B x y"]
    assert each(spark, ["0001-23-4", "00123"], text.accession_key) == ["1234", "123"]
    assert each(spark, [" 1396440 ", "0000012"], text.padded_cik) == ["0001396440", "0000000012"]
    assert each(spark, ["ABC, Inc. - 1st"], text.cleaned_identifier) == ["abc inc 1st"]


def lines(spark, content):
    return spark.createDataFrame([(x,) for x in content.split("\n")], "value string")


def values(series):
    return sorted((r.date, r.value) for r in series.collect())


def test_rate_files(spark):
    fred = lines(spark, "DATE,SOFR\n2024-01-02,5.3\n2024-01-03,.\n2024-04-01,5.1")
    assert values(files.parse_dated_csv(fred)) == [(D(2024, 1, 2), 5.3), (D(2024, 4, 1), 5.1)]
    assert values(files.parse_dated_csv(lines(spark, "Date,IUDSOIA\n02 Jan 2024,5.18"), "dd MMM yyyy")) == [(D(2024, 1, 2), 5.18)]
    rba = lines(spark, "Title\nSeries ID,X,FIRMMBAB90D\n31-Jan-2024,1,4.35\n29-Feb-2024,2,")
    assert values(files.parse_named_csv(rba, "Series ID", "FIRMMBAB90D", "dd-MMM-yyyy")) == [(D(2024, 1, 31), 4.35)]
    boj = lines(spark, "note\nSERIES_CODE,SURVEY_DATES,VALUES\nA,20240131,0.1")
    assert values(files.parse_named_csv(boj, "SERIES_CODE", "VALUES", "yyyyMMdd", "SURVEY_DATES")) == [(D(2024, 1, 31), 0.1)]
    snb = lines(spark, '﻿"CubeId";"x"\n"Date";"D0";"Value"\n"2024-01-31";"H0";"1.7"\n"2024-01-31";"H1";"9"')
    assert values(files.parse_dated_csv(snb, sep=";", value=2, only=(1, "H0"))) == [(D(2024, 1, 31), 1.7)]
    ecb = lines(spark, "KEY,TIME_PERIOD,OBS_VALUE\nk,2024-Q1,3.9\nk,2024-Q2,3.8")
    assert values(files.parse_quarterly_csv(ecb, "TIME_PERIOD", "OBS_VALUE")) == [(D(2024, 1, 1), 3.9), (D(2024, 4, 1), 3.8)]


def test_json_rate_files(spark):
    text_of = lambda x: spark.createDataFrame([(x,)], "value string")
    boc = text_of('{"observations":[{"d":"2024-01-02","AVG.INTWO":{"v":"5.0"}},{"d":"2024-01-03"}]}')
    assert values(files.parse_json_records(boc, "observations array<struct<d:string,`AVG.INTWO`:struct<v:string>>>", "j.observations", "r.d", "r.`AVG.INTWO`.v")) == [(D(2024, 1, 2), 5.0)]
    shibor = text_of('{"records":[{"showDateCN":"2024-01-02","3M":"2.4"}]}')
    assert values(files.parse_json_records(shibor, "records array<struct<showDateCN:string,`3M`:string>>", "j.records", "r.showDateCN", "r.`3M`")) == [(D(2024, 1, 2), 2.4)]
    ecos = text_of('[{"TIME":"2024Q1","DATA_VALUE":"3.6"}]')
    assert values(files.parse_json_records(ecos, "array<struct<TIME:string,DATA_VALUE:string>>", "j", "r.TIME", "r.DATA_VALUE", "quarter")) == [(D(2024, 1, 1), 3.6)]
    sing = text_of('{"Data":{"row":[{"seriesNo":"22","columns":[{"key":"2024 Jan","value":"9"}]},{"seriesNo":"23","columns":[{"key":"2024 Jan","value":"3.7"}]}]}}')
    schema = "Data struct<row:array<struct<seriesNo:string,columns:array<struct<key:string,value:string>>>>>"
    assert values(files.parse_json_records(sing, schema, "flatten(transform(filter(j.Data.row, x -> x.seriesNo = '23'), x -> x.columns))", "r.key", "r.value", "yyyy MMM")) == [(D(2024, 1, 1), 3.7)]


def test_quarters_of_series(spark):
    rows = [(D(2024, 1, 31), 1.0), (D(2024, 2, 29), 2.0), (D(2024, 3, 28), 4.0), (D(2024, 3, 29), 6.0), (D(2024, 4, 30), 8.0), (D(2010, 1, 1), 9.0)]
    series = spark.createDataFrame(rows, "date date, value double")
    as_dict = lambda x: {r.cal_q: r.value for r in x.collect()}
    assert as_dict(files.quarterly_mean(series)) == {"2024Q1": 3.25, "2024Q2": 8.0} and as_dict(files.quarterly_mean(series, months=4)) == {"2024Q1": 3.25}
    assert as_dict(files.quarter_end_value(series)) == {"2024Q1": 6.0}
    base = spark.createDataFrame([("2024Q1",), ("2024Q3",)], "cal_q string")
    assert sorted((r.cal_q, r.x) for r in files.augment(base, {"x": files.quarterly_mean(series)}).collect()) == [("2024Q1", 3.25), ("2024Q3", None)]
    wide = spark.createDataFrame([("2024-03-31", "2024Q1 ", 5.3, None)], "DATE string, `TIME PERIOD` string, `USD SOFR` double, `eur EURIBOR 3-month` double")
    assert [(r.cal_q, r.currency, round(r.base, 4)) for r in files.base_rates(wide).collect()] == [("2024Q1", "USD", 0.053)]
    fx = spark.createDataFrame([("2024-03-31", "Japan-Yen", "150"), ("2024-01-31", "Japan-Yen", "140"), ("x", "Japan-Yen", "1"), ("2024-03-31", "Mars-Dust", "2")], "`Effective Date` string, `Country - Currency Description` string, `Exchange Rate` string")
    countries = spark.createDataFrame([("Japan", "JPY")], "country string, currency string")
    assert [tuple(r) for r in files.exchange_rates(fx, countries).where("cal_q is not null").collect()] == [("2024Q1", "JPY", 145.0)]


def test_filing_index_and_lags(spark):
    index = lines(spark, "Description\nCIK|Company|Form|Date|File\n-----\n12|A Co|N-54A|2020-01-02|edgar/1\n12|A Co|N-54A|2020-01-02|edgar/1\n13|B|10-K|2020-01-02|edgar/2\n14|C|N-54A/A|2020-01-02|edgar/3\nshort|line")
    assert [tuple(r) for r in files.filing_index(index, prefix="p/").collect()] == [("0000000012", "N-54A", D(2020, 1, 2), "p/edgar/1", "A Co")]
    assert {r.CIK for r in files.filing_index(index, files.form_pattern(["N-54A", "N-54C"], True)).collect()} == {"0000000012", "0000000014"}
    filings = spark.createDataFrame([("1", "2024Q1"), ("2", "2024Q1"), ("3", "2024Q1"), ("9", "2020Q1")], "key string, cal_q string")
    meta = spark.createDataFrame([("1", D(2024, 5, 10), "10-Q"), ("2", D(2024, 7, 1), "10-K"), ("2", D(2024, 8, 1), "10-K")], "key string, filed date, form string")
    got = files.filing_lags(filings, meta).first()
    assert (got.filings, got.with_filing_date, got.annual_reports, got.median_days, got.max_days) == (3, 2, 1, 66.0, 92)
    assert got.within_45_days == pytest.approx(1 / 3) and got.within_90_days == pytest.approx(1 / 3) and got.filed_before_quarter_end == 0


def test_lender_types(spark):
    rows = [(1, "8-A12B", D(2012, 1, 1), True), (1, "N-2", D(2011, 1, 1), True), (2, "8-A12B", D(2010, 1, 1), False), (2, "25-NSE", D(2020, 1, 1), False), (3, "10-12G", D(2021, 1, 1), False), (5, "10-K", D(2021, 1, 1), True)]
    rows += [(4, "N-2", D(2018, 1, 1), False)] + [(4, f"424B{i}", D(2018, 2 + i, 1), False) for i in (1, 2, 3)] + [(3, "N-2", D(2021, 6, 1), False), (3, "497", D(2021, 7, 1), False)]
    found = files.lender_types(spark.createDataFrame(rows, "cik int, form string, date date, has_ticker boolean"))
    at = lambda day: {r.cik: r.t for r in found.select("cik", files.type_in_quarter(F.lit(day)).alias("t")).collect()}
    assert at(D(2019, 12, 31)) == {1: "listed", 2: "listed", 3: "private", 4: "non-traded", 5: "listed"}
    assert at(D(2018, 2, 1))[4] == "private" and at(D(2020, 3, 31))[2] == "private" and at(D(2011, 6, 30))[1] == "private"
