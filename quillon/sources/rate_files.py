"""Reference-rate files of central banks as ``(date, value)`` rows, their quarters, exchange rates, and filing indexes.

Each reader takes a DataFrame of lines (``value``) or of whole texts, as ``spark.read.text`` gives, so files are read by Spark, however many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.quarters import q_label, qsort_of_date
from quillon.functions.text import padded_cik

#: First day of the series that is used.
START = "2015-01-01"
FORMS = r"(?i)^(?:N-54A|N-54C)$"


def _fields(lines: DataFrame, sep: str = ",") -> Column:
    return F.transform(F.split(F.regexp_replace("value", "^﻿", ""), sep), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))


def _series(lines: DataFrame, date: Column, value: Column) -> DataFrame:
    """Rows whose date and value can be read; headers, titles and gaps cannot."""
    return lines.select(date.alias("date"), value.try_cast("double").alias("value")).where("date is not null and value is not null")


def _day(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def parse_dated_csv(lines: DataFrame, form: str = "yyyy-MM-dd", sep: str = ",", date: int = 0, value: int = 1, only: tuple[int, str] | None = None) -> DataFrame:
    """Lines with a date and a value at fixed places; ``only`` keeps those with a text at a third."""
    f = _fields(lines, sep)
    if only:
        lines = lines.where(F.get(f, F.lit(only[0])) == only[1])
    return _series(lines, _day(F.get(f, F.lit(date)), form), F.get(f, F.lit(value)))


def parse_named_csv(lines: DataFrame, header: str, column: str, form: str, date: str | None = None, sep: str = ",") -> DataFrame:
    """Lines below the one that begins with ``header``; the columns of ``date`` (default ``header``) and of the value are found by name.

    The header is one line, and is joined as one row.
    """
    names = lines.where(F.get(_fields(lines, sep), F.lit(0)) == header).select(_fields(lines, sep).alias("_names")).limit(1)
    both = lines.crossJoin(F.broadcast(names))
    at = lambda name: (F.array_position("_names", F.lit(name)) - 1).cast("int")
    f = _fields(lines, sep)
    return _series(both, _day(F.get(f, at(date or header)), form), F.get(f, at(column)))


def quarter_date(label: Column) -> Column:
    """The first day of a quarter written ``2024-Q1`` or ``2024Q1``."""
    year, n = F.regexp_extract(label, r"^(\d{4})", 1), F.regexp_extract(label, r"Q([1-4])$", 1)
    return F.when((year != "") & (n != ""), F.make_date(year.try_cast("int"), n.try_cast("int") * 3 - 2, F.lit(1)))


def parse_quarterly_csv(lines: DataFrame, header: str, column: str) -> DataFrame:
    """As ``parse_named_csv``, of quarters."""
    names = lines.where(F.array_contains(_fields(lines), header)).select(_fields(lines).alias("_names")).limit(1)
    both = lines.crossJoin(F.broadcast(names))  # one row
    f, at = _fields(lines), lambda name: (F.array_position("_names", F.lit(name)) - 1).cast("int")
    return _series(both, quarter_date(F.get(f, at(header))), F.get(f, at(column)))


def parse_json_records(texts: DataFrame, schema: str, records: str, date: str, value: str, form: str = "yyyy-MM-dd") -> DataFrame:
    """Whole JSON texts with a list of records: ``records``, ``date`` and ``value`` are expressions over the parsed text ``j`` and a record ``r``."""
    rows = texts.select(F.from_json("value", schema).alias("j")).select(F.expr(f"explode({records})").alias("r"))
    when = quarter_date(F.expr(date).cast("string")) if form == "quarter" else _day(F.expr(date).cast("string"), form)
    return _series(rows, when, F.expr(value).cast("string"))


def quarterly_mean(series: DataFrame, start: str = START, months: int | None = None) -> DataFrame:
    """``(cal_q, value)``: the mean by quarter from ``start`` on; with ``months``, of quarters with so many values alone."""
    q = qsort_of_date(F.col("date"))
    out = series.where(F.col("date") >= F.lit(start).cast("date")).groupBy(q_label(q).alias("cal_q")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return (out.where(F.col("n") == months) if months else out).drop("n")


def quarter_end_value(series: DataFrame, start: str = START) -> DataFrame:
    """``(cal_q, value)``: the value of the quarter's last month, its latest one."""
    last = series.where((F.col("date") >= F.lit(start).cast("date")) & (F.month("date") % 3 == 0))
    return last.groupBy(q_label(qsort_of_date(F.col("date"))).alias("cal_q")).agg(F.max_by("value", "date").alias("value"))


def augment(base: DataFrame, series: dict[str, DataFrame], digits: int = 4) -> DataFrame:
    """``base`` (a row per ``cal_q``) with a column for each series, rounded; quarters a series lacks are null."""
    for name, rows in series.items():
        base = base.join(rows.select("cal_q", F.round("value", digits).alias(name)), "cal_q", "left")
    return base


def base_rates(wide: DataFrame, quarter: str = "TIME PERIOD") -> DataFrame:
    """``(cal_q, currency, base)`` from a wide file in percent: a column's currency is the first word of its name."""
    names = [c for c in wide.columns if c not in (quarter, "DATE")]
    pairs = F.array(*[F.struct(F.lit(c.split()[0].upper()).alias("currency"), (F.col(f"`{c}`").cast("double") / 100).alias("base")) for c in names])
    return wide.select(F.trim(F.col(f"`{quarter}`").cast("string")).alias("cal_q"), F.explode(pairs).alias("p")).select("cal_q", "p.currency", "p.base").where("base is not null")


def exchange_rates(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """``(cal_q, currency, per_usd)``: the mean rate by quarter; ``countries`` maps the country before the dash to its currency."""
    out = rows.select(
        q_label(qsort_of_date(F.col("Effective Date").try_cast("date"))).alias("cal_q"),
        F.trim(F.substring_index("Country - Currency Description", "-", 1)).alias("country"),
        F.col("Exchange Rate").try_cast("double").alias("rate"),
    )
    return out.join(F.broadcast(countries), "country").groupBy("cal_q", "currency").agg(F.avg("rate").alias("per_usd"))  # a row per country


def filing_index(lines: DataFrame, forms: str = FORMS, prefix: str = "") -> DataFrame:
    """``(CIK, Company, Form, Date, Link)`` of a filing index of five fields parted by bars, by form, once each; other lines are no filings."""
    f = F.transform(F.split("value", r"\|"), F.trim)
    rows = lines.where((F.size(f) >= 5) & F.get(f, F.lit(0)).rlike(r"^\d+$") & F.get(f, F.lit(2)).rlike(forms))
    at = lambda i: F.get(f, F.lit(i))
    out = rows.select(padded_cik(at(0)).alias("CIK"), at(1).alias("Company"), at(2).alias("Form"), at(3).try_cast("date").alias("Date"), F.concat(F.lit(prefix), at(4)).alias("Link"))
    return out.groupBy("CIK", "Form", "Date", "Link").agg(F.min("Company").alias("Company"))


def form_pattern(forms: list[str], amendments: bool = False) -> str:
    """A pattern for whole form names, with ``/A`` where amendments count."""
    return f"(?i)^(?:{'|'.join(forms)}){'(?:/A)?' if amendments else ''}$"


def filing_lags(filings: DataFrame, metadata: DataFrame, first_q: str = "2023Q1") -> DataFrame:
    """Per quarter: filings, days from the quarter's end to the filing date (median, largest, shares within 45 and 90), first and last date.

    ``filings``: ``(key, cal_q)``; ``metadata``: ``(key, filed, form)``, one row a key.
    """
    once = metadata.groupBy("key").agg(F.min_by(F.struct("filed", "form"), F.struct("filed", "form")).alias("m")).select("key", "m.*")
    end = F.last_day(F.make_date(F.substring("cal_q", 1, 4).cast("int"), F.substring("cal_q", -1, 1).cast("int") * 3, F.lit(1)))
    rows = filings.where(F.col("cal_q") >= first_q).distinct().join(once, "key", "left").withColumn("lag", F.datediff("filed", end))
    within = lambda n: F.avg(F.coalesce((F.col("lag") <= n).cast("int"), F.lit(0)))
    return rows.groupBy("cal_q").agg(
        F.count("*").alias("filings"),
        F.count("filed").alias("with_filing_date"),
        F.count(F.when(F.col("form") == "10-K", 1)).alias("annual_reports"),
        F.percentile("lag", F.lit(0.5)).alias("median_days"),
        F.max("lag").alias("max_days"),
        F.min("filed").alias("first_filing"),
        F.max("filed").alias("last_filing"),
        within(45).alias("within_45_days"),
        within(90).alias("within_90_days"),
        F.count(F.when(F.col("lag") < 0, 1)).alias("filed_before_quarter_end"),
    )


def lender_types(history: DataFrame, overrides: DataFrame | None = None, least_prospectuses: int = 3) -> DataFrame:
    """Per lender: ``listed_from``, ``listed_to`` and ``non_traded_from``, from its filings ``(cik, form, date, has_ticker)``.

    A lender was listed if it has a ticker, or registered a listing and left it.
    It was non-traded from the first of three or more prospectuses after its registration, before any listing.
    """
    delisted = F.col("form").isin("25", "25-NSE")
    per = history.groupBy("cik").agg(
        F.max("has_ticker").alias("_ticker"),
        F.min(F.when(F.col("form") == "8-A12B", F.col("date"))).alias("_listing"),
        F.count(F.when(delisted, 1)).alias("_gone"),
        F.max(F.when(delisted, F.col("date"))).alias("_last"),
    )
    was = F.col("_ticker") | (F.col("_listing").isNotNull() & (F.col("_gone") > 0))
    per = per.withColumn("listed_from", F.when(was, F.coalesce("_listing", F.lit("1900-01-01").cast("date"))))
    per = per.withColumn("listed_to", F.when(was & ~F.col("_ticker") & (F.col("_last") > F.col("listed_from")), F.col("_last")))
    before = history.join(per.select("cik", "listed_from"), "cik").where(F.col("date") < F.coalesce("listed_from", F.lit("2100-01-01").cast("date")))
    registered = F.min(F.when(F.col("form") == "N-2", F.col("date"))).over(Window.partitionBy("cik"))
    offers = before.withColumn("_registered", registered).where((F.col("form").startswith("424B") | (F.col("form") == "497")) & (F.col("date") > F.col("_registered")))
    sold = offers.groupBy("cik").agg(F.count("*").alias("_n"), F.min("date").alias("_first")).where(F.col("_n") >= least_prospectuses)
    out = per.select("cik", "listed_from", "listed_to").join(sold.select("cik", F.col("_first").alias("non_traded_from")), "cik", "left")
    return out.join(overrides.select("cik", "override"), "cik", "left") if overrides is not None else out.withColumn("override", F.lit(None).cast("string"))


def type_in_quarter(quarter_end: Column) -> Column:
    """listed, non-traded or private at a quarter's end, by the columns of ``lender_types``."""
    listed = (F.col("listed_from") <= quarter_end) & (F.col("listed_to").isNull() | (quarter_end < F.col("listed_to")))
    return F.when(F.col("override").isNotNull(), F.col("override")).when(listed, "listed").when(F.col("non_traded_from") <= quarter_end, "non-traded").otherwise("private")
