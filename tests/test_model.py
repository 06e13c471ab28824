import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import model


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 600
    x = np.column_stack([rng.uniform(0.5, 1.1, n), rng.normal(0, 0.08, n)])
    p = 1 / (1 + np.exp(-(3.0 - 6.0 * np.maximum(x[:, 0], 0.7) - 5 * np.clip(x[:, 1], -0.2, 0.2))))
    y = (rng.uniform(size=n) < p).astype(int)
    return [(f"b{i % 90}", int(8000 + i // 100), float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "borrower string, qsort int, price double, d_price double, y int")


def by_hand(rows, units=(1.0, 1.0)):
    x = np.array([[1, max(r[2], 0.7) / units[0], min(max(r[3], -0.2), 0.2) / units[1]] for r in rows])
    y, g = np.array([r[4] for r in rows], float), np.array([r[0] for r in rows])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    bread = np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))
    s = np.array([(x * (y - p)[:, None])[g == k].sum(axis=0) for k in sorted(set(g))])
    return beta, len(s) / (len(s) - 1) * bread @ (s.T @ s) @ bread, p


def test_fit_equals_newton_by_hand(frame, rows):
    got = model.fit_logit(frame, ["price", "d_price"])
    beta, cov, _ = by_hand(rows)
    assert got.beta == pytest.approx(beta, abs=1e-7) and got.cov == pytest.approx(cov, abs=1e-8)
    assert (got.rows, got.clusters, got.events) == (600, 90, sum(r[4] for r in rows)) and 0 < got.fit < 1


def test_coefficients_per_unit(frame, rows):
    table = {r.term: r for r in model.coefficient_table(frame, ["price", "d_price"]).collect()}
    beta, cov, _ = by_hand(rows, (0.10, 0.05))
    assert table["price"].coef == pytest.approx(beta[1], abs=1e-6) and table["d_price"].se_cluster == pytest.approx(math.sqrt(cov[2, 2]), abs=1e-6)
    assert table["price"].odds_ratio == pytest.approx(math.exp(beta[1])) and table["const"].per is None and 0 <= table["price"].p_value <= 1


def test_training_windows_close_before_the_test(frame, rows):
    with pytest.raises(ValueError, match="windows"):
        model.split_predictions(frame, ["price"], 8003, [8004])
    got = model.split_predictions(frame, ["price", "d_price"], 8003, [8005]).collect()
    beta, _, _ = by_hand([r for r in rows if r[1] <= 8003])
    want = {(r[0], r[2]): 1 / (1 + math.exp(-(beta[0] + beta[1] * max(r[2], 0.7) + beta[2] * min(max(r[3], -0.2), 0.2)))) for r in rows if r[1] == 8005}
    assert len(got) == 100 and all(r.pred == pytest.approx(want[r.borrower, r.price], abs=1e-7) for r in got)


def test_rolling_sees_closed_windows_alone(frame):
    got = model.rolling_predictions(frame, ["price"]).groupBy("qsort", "train_last_q").count().collect()
    assert sorted((r.qsort, r.train_last_q) for r in got) == [(8004, 8002), (8005, 8003)]


def test_one_outcome_is_refused(frame):
    with pytest.raises(ValueError, match="both"):
        model.fit_logit(frame.withColumn("y", F.lit(0)), ["price"])


def test_intervals_hold_the_value(frame):
    scored = frame.withColumn("pred", 1.2 - F.col("price"))
    ratio = model.ratio_interval(scored, F.col("y"), F.lit(1), resamples=200).first()
    assert ratio.ci_low < ratio.value < ratio.ci_high and 0.02 < ratio.ci_high - ratio.ci_low < 0.2
    assert ratio == model.ratio_interval(scored.repartition(3), F.col("y"), F.lit(1), resamples=200).first()
    for measure in ("auc", "average_precision"):
        got = model.score_interval(scored, measure, resamples=60).first()
        assert got.ci_low < got.value < got.ci_high
    gain = model.auc_gain(scored, scored.withColumn("pred", F.xxhash64("price") * 1.0), resamples=60).first()
    assert gain.ci_low < gain.value < gain.ci_high and gain.value > 0
    recall = model.recall_interval(scored, 0.2, resamples=60).first()
    assert recall.ci_low <= recall.value <= recall.ci_high


def test_resamples_draw_each_group_once_on_average(spark):
    groups = spark.range(400).select(F.col("id").cast("string").alias("g"))
    got = model._resampled(groups, "g", 50, 1).agg(F.sum("_w")).first()[0]
    assert abs(got / 20_000 - 1) < 0.03


def test_equal_weight_score(spark):
    rows = [("a", 1, 0.9, 0.1), ("b", 1, 0.8, 0.2), ("c", 1, 0.95, 0.0), ("d", 2, 0.5, 0.0)]
    got = {r.borrower: r.pred for r in model.equal_weight_score(spark.createDataFrame(rows, "borrower string, qsort int, price double, max_drawdown double"), ["price", "max_drawdown"]).collect()}
    assert got == pytest.approx({"a": 2 / 3, "b": 1.0, "c": 1 / 3, "d": 1.0})


def test_regression_scores(spark):
    got = model.regression_scores(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double"), "y", "p", 2.0).first()
    assert got.r2 == pytest.approx(1 - 1.25 / 5) and got.rmse == pytest.approx(math.sqrt(1.25 / 3)) and got.rmse_benchmark == pytest.approx(math.sqrt(5 / 3))


@pytest.mark.parametrize("y, events", [(0, 0), (1, 600)])
def test_table_of_one_outcome_counts_and_knows_no_coefficient(frame, y, events):
    got = model.coefficient_table(frame.withColumn("y", F.lit(y)), ["price", "d_price"]).collect()
    assert [(r.term, r.per, r.n_obs, r.n_borrowers, r.n_events, r.status) for r in got] == [
        (t, per, 600, 90, events, "one outcome") for t, per in (("const", None), ("price", 0.10), ("d_price", 0.05))
    ]
    assert all(r[c] is None for r in got for c in ("coef", "se_cluster", "z", "p_value", "ci_low", "ci_high", "odds_ratio", "or_ci_low", "or_ci_high", "pseudo_r2"))
    empty = model.coefficient_table(frame.where("y > 1"), ["price"]).collect()
    assert [(r.term, r.coef, r.n_obs, r.n_borrowers, r.n_events) for r in empty] == [("const", None, 0, 0, 0), ("price", None, 0, 0, 0)]


def test_separated_outcomes_have_no_coefficient(frame):
    high = F.col("price") > 0.9
    whole = frame.withColumn("y", high.cast("int"))
    one_row = frame.withColumn("y", (F.col("price") < frame.agg(F.max("price")).first()[0]).cast("int"))
    # Above the price all rows are events, below it both outcomes occur at either change of price.
    part = frame.withColumn("y", F.when(high, 1).otherwise(F.col("qsort") % 2)).withColumn("price", F.when(high, 1.0).otherwise(0.8))
    for labelled in (whole, one_row, part):
        got = model.coefficient_table(labelled, ["price", "d_price"]).collect()
        assert {r.status for r in got} == {"separated"} and all(r.coef is None and r.or_ci_high is None and 0 < r.pseudo_r2 < 1 + 1e-9 for r in got)
    fitted = model.fit_logit(whole, ["price", "d_price"])
    assert fitted.separated and model.score(whole, fitted).where(F.abs(F.col("pred") - F.col("y")) > 0.01).count() == 0


def test_outcomes_that_barely_overlap_are_fitted(spark):
    rows = [(f"b{i % 20}", 1, 0.70 + i / 1000, float(i % 7 - 3) / 50, int(i >= 100)) for i in range(200)]
    rows += [("b3", 1, 0.803, 0.0, 0), ("b4", 1, 0.797, 0.01, 1)]
    got = {r.term: r for r in model.coefficient_table(spark.createDataFrame(rows, "borrower string, qsort int, price double, d_price double, y int"), ["price", "d_price"]).collect()}
    beta, cov, _ = by_hand(rows, (0.10, 0.05))
    assert {r.status for r in got.values()} == {"fitted"} and got["price"].coef > 50
    assert [got[t].coef for t in ("const", "price", "d_price")] == pytest.approx(beta, rel=1e-6) and got["price"].se_cluster == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-5)


def test_odds_beyond_the_doubles_are_infinite(frame):
    got = {r.term: r for r in model.coefficient_table(frame.withColumn("y", 1 - F.col("y")), ["price"], units={"price": 1000.0}).collect()}
    assert got["price"].coef > 1000 and got["price"].odds_ratio == math.inf and got["price"].status == "fitted"


def test_predictors_that_tell_nothing_apart_are_named(frame):
    for other in (F.lit(0.1), F.lit(0.0), F.col("price") / 10):
        got = model.coefficient_table(frame.withColumn("d_price", other), ["price", "d_price"], caps={}, units={}).collect()
        assert [(r.coef, r.status, r.n_obs) for r in got] == [(None, "collinear", 600)] * 3
