import pytest

from quillon.operators import credit_status as credit


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_drawdown_on_a_dense_grid(spark):
    changes = spark.createDataFrame(
        [("A", 10, None), ("A", 11, -0.01), ("A", 13, -0.04), ("A", 14, -0.05), ("A", 19, 0.0), ("B", 12, 0.02)],
        "borrower string, qsort int, d_price double",
    )
    got = {(r.borrower, r.qsort): r.drawdown for r in credit.rolling_max_drawdown(changes).collect()}
    assert len(got) == 20
    assert got["A", 10] is None and got["B", 11] is None
    assert [got["A", q] for q in (11, 12, 13, 14)] == pytest.approx([0.01, 0.01, 0.05, 0.10])
    assert got["A", 16] == pytest.approx(0.09)  # the first fall has left the window
    assert got["A", 18] is None and got["A", 19] == 0
    assert got["B", 12] == 0


def test_status_over_lenders_and_entries(spark):
    loans = spark.createDataFrame(
        [("A", 1, 7, 0, 5.0), ("A", 1, 8, None, 1.0), ("A", 2, 8, None, 1.0), ("A", 3, 7, 1, 4.0), ("A", 3, 7, 0, 1.0), ("A", 4, 7, 0, 1.0), ("B", 1, 7, 0, 1.0), ("B", 4, 7, 1, 1.0)],
        "borrower string, qsort int, cik long, non_accrual int, FV double",
    )
    lenders = credit.lender_status(loans)
    got = rows_of(credit.borrower_status(lenders).where("borrower = 'A'"), "qsort", "na_status", "n_lenders_known", "fv_debt", "na_ever")
    assert got == [(1, 0, 1, 6.0, 0), (2, None, 0, 1.0, 0), (3, 1, 1, 5.0, 1), (4, 0, 1, 1.0, 1)]
    assert rows_of(credit.same_lender_entries(lenders), "borrower", "qsort") == [("A", 1)]
    assert rows_of(credit.same_lender_entries(lenders, 3), "borrower", "qsort") == [("A", 1), ("B", 1)]


def test_intervals_of_starts_and_ends(spark):
    events = spark.createDataFrame(
        [(1, "C", 1, 1), (1, "A", 2, 2), (1, "A", 3, 3), (1, "x", 4, 4), (1, "C", 5, 5), (1, "C", 6, 6), (1, "A", 7, 7), (2, "A", 1, 8), (2, "C", 1, 9)],
        "who int, form string, at int, id int",
    )
    got = rows_of(credit.status_intervals(events, "who", "form", "at", "A", "C", "id"), "who", "start", "end")
    assert got == sorted([(1, None, 1), (1, 3, 5), (1, None, 6), (1, 7, None), (2, 1, 1)], key=str)


def test_empty_tables(spark):
    loans = spark.createDataFrame([], "borrower string, qsort int, cik long, non_accrual int, FV double, d_price double")
    lenders = credit.lender_status(loans)
    assert credit.borrower_status(lenders).count() == 0
    assert credit.same_lender_entries(lenders).count() == 0
    assert credit.rolling_max_drawdown(loans).count() == 0
