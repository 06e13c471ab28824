"""Calendar quarters as labels ``YYYYQn``, as sortable integers (year * 4 + quarter) and as quarter-end dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qsort_of_date(date: Column) -> Column:
    return F.year(date) * 4 + F.quarter(date)


def qsort(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, -1, 1).cast("int")


def q_label(sort: Column) -> Column:
    zero = sort - 1
    return F.concat(F.floor(zero / 4).cast("string"), F.lit("Q"), (F.pmod(zero, F.lit(4)) + 1).cast("string"))


def q_next(label: Column, k: int = 1) -> Column:
    return q_label(qsort(label) + k)


def quarter_end(date: Column) -> Column:
    return F.last_day(F.make_date(F.year(date), F.quarter(date) * 3, F.lit(1)))


def quarter_end_of_label(label: Column) -> Column:
    return F.last_day(F.make_date(F.substring(label, 1, 4).cast("int"), F.substring(label, -1, 1).cast("int") * 3, F.lit(1)))


def window_label(sort: Column, horizon: int) -> Column:
    """The quarters an outcome is looked for in: ``first-last`` of the ``horizon`` quarters after this one."""
    return F.concat(q_label(sort + 1), F.lit("-"), q_label(sort + horizon))


def add_calendar_quarter(df: DataFrame, date: str, end: str = "cal_qe", label: str = "cal_q") -> DataFrame:
    """``df`` with the end and the label of the quarter ``date`` lies in."""
    return df.withColumns({end: quarter_end(F.col(date)), label: q_label(qsort_of_date(F.col(date)))})
