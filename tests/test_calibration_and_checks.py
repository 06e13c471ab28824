"""Recalibration, panels cut in time, tails: against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import calibration, look_ahead, tails

SCHEMA = "draw int, qsort int, borrower string, pred double, y int, w double"


def scores(seed, draws=3, n=200):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = rng.choice([0.02, 0.1, 0.1, 0.3, 0.7, rng.random()])
        y = int(rng.random() < min(1, p * 1.3))
        out += [(d, 8100 + i % 4, f"b{i:03d}", p, y, float(rng.randrange(4))) for d in range(draws)]
    return out


def newton(rows, slope):
    x = np.array([math.log(min(max(p, 1e-12), 1 - 1e-12) / (1 - min(max(p, 1e-12), 1 - 1e-12))) for _, _, _, p, _, _ in rows])
    y, w = np.array([r[4] for r in rows], float), np.array([r[5] for r in rows])
    beta, X = (np.array([0.0, 1.0]), np.column_stack([np.ones_like(x), x])) if slope else (np.zeros(1), np.ones((len(x), 1)))
    for _ in range(60):
        mu = 1 / (1 + np.exp(-(X @ beta + (0 if slope else x))))
        beta = beta + np.linalg.solve(X.T @ (X * (w * mu * (1 - mu))[:, None]), X.T @ (w * (y - mu)))
    return (beta[0], beta[1]) if slope else (beta[0], 1.0)


@pytest.mark.parametrize("slope", [False, True])
def test_all_draws_at_once_equal_single_fits(spark, slope):
    rows = scores(1)
    got = {r.draw: (r.intercept, r.slope) for r in calibration.recalibrations(spark.createDataFrame(rows, SCHEMA), ["draw"], slope).collect()}
    for d in range(3):
        assert got[d] == pytest.approx(newton([r for r in rows if r[0] == d], slope), abs=1e-8)


def test_measures_and_deciles(spark):
    rows = [r for r in scores(2, draws=1)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = calibration.calibration(df, ["draw"]).first()
    used = [r for r in rows if r[5] > 0]
    w, y, p = (np.array([r[i] for r in used], float) for i in (5, 4, 3))
    assert (m.observed, m.expected, m.brier) == pytest.approx(((w * y).sum(), (w * p).sum(), (w * (p - y) ** 2).sum() / w.sum()))
    assert (m.cal_intercept, m.cal_slope) == pytest.approx((newton(used, False)[0], newton(used, True)[1]), abs=1e-8)
    got = {r.borrower: r.decile for r in calibration.weighted_deciles(df.where("w > 0")).collect()}
    for q in {r[1] for r in used}:
        own = sorted((r for r in used if r[1] == q), key=lambda r: (-r[3], r[2]))
        share = np.cumsum([r[5] for r in own]) / sum(r[5] for r in own)
        assert [got[r[2]] for r in own] == [11 - math.ceil(round(s * 10, 9)) for s in share]
    gaps = {r.decile: (r.realized, r.predicted, r.gap) for r in calibration.decile_gaps(df).collect()}
    for d, (realized, predicted, gap) in gaps.items():
        own = [r for r in used if got[r[2]] == d]
        assert realized == pytest.approx(sum(r[5] * r[4] for r in own) / sum(r[5] for r in own)) and gap == pytest.approx(realized - predicted)
    p2 = df.select(calibration.apply_recalibration(F.col("pred"), F.lit(0.0), F.lit(1.0)).alias("p"), "pred").collect()
    assert all(r.p == pytest.approx(r.pred, abs=1e-9) for r in p2)


def test_sets_do_not_overlap_in_outcomes(spark):
    frame = spark.range(8090, 8110).select(F.col("id").cast("int").alias("qsort"))
    found = {k: sorted(r.qsort for r in v.collect()) for k, v in calibration.recalibration_sets(frame, 8100, [8102, 8103], 2).items()}
    assert found == {"train": list(range(8090, 8101)), "test": [8102, 8103], "recal_set": [8099, 8100], "recal_fit": list(range(8090, 8098))}
    with pytest.raises(ValueError, match="not known"):
        calibration.recalibration_sets(frame, 8101, [8102], 2)


def test_planted_look_ahead_is_found(spark):
    rows = spark.createDataFrame([(b, q, float(b * q % 7)) for b in range(9) for q in range(8)], "borrower int, qsort int, x double")
    by_time = Window.partitionBy("borrower").orderBy("qsort")

    def build(df):
        return df.select("borrower", "qsort", F.lag("x").over(by_time).alias("fair"), F.lead("x").over(by_time).alias("peeks"), F.when(F.max("qsort").over(Window.partitionBy("borrower")) < 6, F.col("x")).alias("blank"))

    got = {r.column: r for r in look_ahead.look_ahead(rows, build, 4, ["borrower", "qsort"], ["fair", "peeks", "blank"]).collect()}
    assert (got["(rows)"].rows_full, got["(rows)"].rows_cut, got["(rows)"].rows_differ) == (45, 45, 0)
    assert (got["fair"].rows_differ, got["fair"].max_abs_diff) == (0, 0.0) and got["peeks"].rows_differ == 9 and got["blank"].rows_differ == 45
    closed = {r.column: r.rows_differ for r in look_ahead.look_ahead(rows, build, 4, ["borrower", "qsort"], ["peeks"], closed=1).collect()}
    assert closed["peeks"] == 0
    apart = look_ahead.compare_panels(rows, rows.where("borrower < 8").withColumn("x", F.col("x") + 0.5), ["borrower", "qsort"], ["x"]).collect()
    assert (apart[0].rows_differ, apart[1].rows_differ, apart[1].max_abs_diff) == (8, 64, 0.5)


def test_order_of_a_sum_is_no_look_ahead(spark):
    rng = random.Random(6)
    lists = [[rng.uniform(900, 90_000) for _ in range(900)] for _ in range(40)]
    ahead, back = [sum_in_order(x) for x in lists], [sum_in_order(x[::-1]) for x in lists]
    assert sum(abs(a - b) > look_ahead.TOLERANCE for a, b in zip(ahead, back, strict=True)) > 20
    small = [0.5 + 2e-9 * (i % 2) for i in range(40)]  # a share is held to 1e-9
    far = [math.inf, math.nan, None, *[a * (1 + 1e-10) for a in ahead[3:]]]
    schema = "id int, summed double, share double, far double, none double"
    full = spark.createDataFrame([(i, a, 0.5, a, 0.0) for i, a in enumerate(ahead)], schema)
    early = spark.createDataFrame([(i, b, s, f, 0.0) for i, (b, s, f) in enumerate(zip(back, small, far, strict=True))], schema)
    got = {r.column: r.rows_differ for r in look_ahead.compare_panels(full, early, ["id"], ["summed", "share", "far", "none"]).collect()}
    assert got == {"(rows)": 0, "summed": 0, "share": 20, "far": 40, "none": 0}


def sum_in_order(values):
    total = 0.0
    for v in values:  # the built-in sum makes up for rounding
        total += v
    return total


def test_robust_moments_and_quantiles_without_a_group(spark):
    import pandas as pd

    rng = random.Random(4)
    rows = [(g, None if rng.random() < 0.05 else rng.choice([0.0, round(rng.gauss(0, 1), 2), rng.gauss(0, 5)])) for g in range(7) for _ in range(rng.randrange(1, 60))] + [(8, 0.5)]
    df, pdf = spark.createDataFrame(rows, "g int, x double"), pd.DataFrame(rows, columns=["g", "x"]).dropna()
    for r in tails.robust_moments(df, "x", "g").collect():
        x = pdf.x[pdf.g == r.g]
        assert (r.n, r.median, r.mad_sigma) == (len(x), pytest.approx(x.median()), pytest.approx(1.4826 * (x - x.median()).abs().median()))
        assert r.skew == pytest.approx(x.skew()) if len(x) > 2 else r.skew is None
        assert r.kurtosis == pytest.approx(x.kurt()) if len(x) > 3 else r.kurtosis is None
    for q in (0.01, 0.25, 0.5, 1.0):
        got = {r.g: r.quantile for r in tails.quantiles_without(df, "x", "g", q).collect()}
        assert got == {g: pytest.approx(pdf.x[pdf.g != g].quantile(q)) for g in pdf.g.unique()}
    assert [tuple(r) for r in tails.quantiles_without(df.where("g = 8"), "x", "g", 0.5).collect()] == [(8, None)]
