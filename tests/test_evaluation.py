import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation


@pytest.fixture(scope="module")
def scored():
    rng = random.Random(3)
    return [(f"b{i}", q, rng.choice([0.1, 0.2, 0.3, 0.5, 0.9]), int(rng.random() < 0.3), rng.choice([1.0, 2.0])) for q in (1, 2) for i in range(40)]


@pytest.fixture(scope="module")
def frame(spark, scored):
    return spark.createDataFrame(scored, "borrower string, qsort int, pred double, y int, w double")


def test_auc_equals_all_pairs(frame, scored):
    got = {r.qsort: r.auc for r in evaluation.roc_auc(frame, weight="w").collect()}
    for q in (1, 2):
        pairs = [(a[4] * b[4], (a[2] > b[2]) + 0.5 * (a[2] == b[2])) for a in scored for b in scored if a[1] == b[1] == q and a[3] > b[3]]
        assert got[q] == pytest.approx(sum(w * s for w, s in pairs) / sum(w for w, _ in pairs))


def test_average_precision_walks_down_the_scores(frame, scored):
    got = {r.qsort: r.average_precision for r in evaluation.average_precision(frame).collect()}
    for q in (1, 2):
        rows, want = [r for r in scored if r[1] == q], 0.0
        for s in {r[2] for r in rows}:
            top = [r for r in rows if r[2] >= s]
            want += sum(r[3] for r in rows if r[2] == s) * sum(r[3] for r in top) / len(top)
        assert got[q] == pytest.approx(want / sum(r[3] for r in rows))


def test_one_class_has_no_auc(frame):
    assert {r.auc for r in evaluation.roc_auc(frame.withColumn("y", F.lit(0))).collect()} == {None}


def test_top_decile(spark):
    rows = [(f"{q}-{i:02}", q, 1 - i / 100, int(i in (0, 1, 7))) for q in (1, 2) for i in range(20)]
    frame = spark.createDataFrame(rows, "borrower string, qsort int, pred double, y int")
    table = {r.decile: r for r in evaluation.decile_table(frame).collect()}
    assert sorted(table) == list(range(1, 11))
    assert (table[10].n, table[10].events) == (4, 4) and table[10].share_of_events == pytest.approx(4 / 6)
    every = next(r for r in evaluation.recall_at(frame, 0.1).collect() if r.qsort is None)
    assert (every.caught, every.events) == (4, 6)
