import pytest

from quillon.operators import exposure

PANEL = "borrower string, cal_q string, qsort int, par double, C1_families int, V1_range double, pik_share double, toggle_par_share double"


@pytest.fixture(scope="module")
def flags(spark):
    rows = []
    for i in range(20):  # one size each; the largest four are one size group
        for q in range(6):
            year, n = 2024 + q // 4, q % 4 + 1
            families = 7 if i == 19 else 2
            gap = 0.01 * i if i >= 10 else None
            pik = None if i == 0 else 0.6 if i == 1 else 0.5
            toggle = 0.3 if (i == 2 and q == 1) else None if i == 3 else 0.0
            rows.append((f"B{i:02}", f"{year}Q{n}", year * 4 + n, float(i + 1), families, gap, pik, toggle))
    got = exposure.warning_flags(spark.createDataFrame(rows, PANEL), "2024Q3").collect()
    return {(r.borrower, r.cal_q): r for r in got}


def test_crowding_is_ranked_within_size(flags):
    assert [flags[f"B{i:02}", "2024Q1"].size_group for i in (0, 3, 4, 15, 16, 19)] == [1, 1, 2, 4, 5, 5]
    assert flags["B19", "2024Q1"].crowding_upper_share == 0.25 and flags["B19", "2024Q1"].crowding == 0
    assert flags["B18", "2024Q1"].crowding_upper_share == 1.0


def test_disagreement_is_ranked_among_shared_borrowers(flags):
    assert [flags[f"B{i:02}", "2024Q2"].disagreement for i in (9, 18, 19)] == [None, 0, 1]


def test_half_in_kind(flags):
    assert [flags[f"B{i:02}", "2024Q2"].pik_half for i in (0, 1, 2)] == [None, 1, 0]


def test_switches(flags):
    quarters = ["2024Q1", "2024Q2", "2024Q3", "2024Q4", "2025Q1", "2025Q2"]
    assert [flags["B02", q].pik_switch_q for q in quarters] == [None, 1, 0, 0, 0, 0]
    assert [flags["B02", q].pik_switched for q in quarters] == [None, None, 1, 1, 1, 0]
    assert [flags["B03", q].pik_switched for q in quarters] == [None, None, 0, 0, 0, 0]  # unknown counts as none


def test_distress(flags):
    assert flags["B02", "2024Q3"].distress == 1 and flags["B02", "2024Q2"].distress == 0 and flags["B19", "2024Q1"].distress == 1 and flags["B00", "2025Q2"].distress == 0


ROWS = "cik int, cal_q string, borrower_canonical string, FV double, COST double, bdc_type string"


def test_weights_and_exposure(spark):
    rows = [(1, "2024Q1", "a", 60.0, 50.0, "x"), (1, "2024Q1", " A ", 10.0, 50.0, "y"), (1, "2024Q1", "B", 20.0, 100.0, "x"), (1, "2024Q1", None, 10.0, 100.0, None)]
    rows += [(1, "2024Q1", "C", 0.0, -5.0, "y"), (2, "2024Q1", "A", 30.0, 30.0, None)]
    frame = spark.createDataFrame(rows, ROWS)
    got = {r.borrower: r for r in exposure.lender_weights(frame).collect()}
    assert got["A"].max_lender_weight == 1.0 and got["A"].mean_lender_weight == pytest.approx((100 / 300 * 100 + 30) / 130) and got["B"].max_lender_weight == pytest.approx(1 / 3)
    assert "C" not in got
    flags = spark.createDataFrame([("A", "2024Q1", 1, 0, 1), ("B", "2024Q1", 0, None, 1)], "borrower string, cal_q string, disagreement int, pik_half int, distress int")
    found = {r.cik: r for r in exposure.lender_exposure(frame, flags, ("disagreement", "pik_half", "distress"), 1).collect()}
    one = found[1]
    assert (one.n_borrowers, one.portfolio_fv, one.bdc_type, one.top_flagged) == (2, 100.0, "x", "A")
    assert (one.exposure_disagreement, one.exposure_distress, one.top_flagged_weight) == pytest.approx((0.7, 0.9, 0.7))
    assert one.concentration == pytest.approx(0.5) and one.effective_n == pytest.approx(2) and found[2].bdc_type is None
    by_quarter = exposure.exposure_by_quarter(exposure.lender_exposure(frame, flags, ("disagreement", "pik_half", "distress"), 1)).first()
    assert (by_quarter.bdcs, by_quarter.over_line, by_quarter.single_name_over) == (2, 2, 2)
