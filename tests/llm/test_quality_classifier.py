import random

import numpy as np
import pytest
from llm_cases import EDGES

from quillon.llm.quality_classifier import fit_cumulative_link, fit_quality_model, score_quality


def test_recovers_ordinal_weights():
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.normal(size=(n, 3))
    latent = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=n)
    grades = (latent > -1).astype(int) + (latent > 1.5)
    rows, slots = np.repeat(np.arange(n), 3), np.tile(np.arange(3), n)
    model = fit_cumulative_link(rows, slots, x.ravel(), grades, 3, l2=0.0, steps=800)
    assert model.weights == pytest.approx([2.0, -1.0, 0.0], abs=0.15)
    assert model.thresholds == pytest.approx([-1.0, 1.5], abs=0.15)
    tails = model.tails(np.array([0.0, 5.0]))
    assert (tails[:, 0] >= tails[:, 1]).all() and tails[1, 1] > tails[0, 1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit_quality_model(docs, labels.where("doc_id % 4 <> 3"))
    scored = score_quality(docs, model).join(labels.where("doc_id % 4 = 3"), "doc_id").collect()
    good = [r.kept for r in scored if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in scored if r.quality == 0]
    toxic = [r.kept for r in scored if r.quality == 1 and r.toxic == 1]
    assert len(toxic) > 5 and np.mean(toxic) < 0.4
    assert len(good) > 50 and np.mean(good) > 0.95
    assert len(bad) > 10 and np.mean(bad) < 0.2


@pytest.fixture(scope="module")
def small_model(spark, docs_of, words):
    rng = random.Random(1)
    rows, ratings = [], []
    for i in range(300):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        text = words(40, seed=i) + ["vilest"] * toxic
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in text)))
        ratings.append((i, int(not bad), int(toxic)))
    labels = spark.createDataFrame([*ratings, (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return fit_quality_model(docs_of(rows), labels, sample=250), rows, ratings


def test_grades_follow_the_ratings(docs_of, small_model):
    model, rows, ratings = small_model
    got = {r.doc_id: r for r in score_quality(docs_of(rows), model).collect()}
    mean = {g: np.mean([got[i].expected_grade for i, q, t in ratings if q + 1 - t == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    assert np.mean([got[i].kept == (q + 1 - t == 2) for i, q, t in ratings]) > 0.95


def test_edges(docs_of, small_model):
    model = small_model[0]
    docs = docs_of(EDGES).selectExpr("*", "'mine' AS kept", "1 AS _text", "array(1) AS a")
    got = score_quality(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "kept"], "expected_grade", "tail_probability", "kept"]
    rows = got.collect()
    assert len(rows) == len(EDGES)
    assert all(not r.kept and r.tail_probability == 0 and r.expected_grade == 0 for r in rows if not (r.text or "").split())
    assert score_quality(docs_of([]), model).count() == 0


def test_no_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_quality_model(docs_of([(1, "a b c")]), labels)
    got = {r.doc_id: r for r in score_quality(docs_of([(1, "a b c"), (2, " "), (3, None)]), model).collect()}
    assert [(got[i].expected_grade, got[i].tail_probability, got[i].kept) for i in (1, 2, 3)] == [(1.0, 0.5, True), (0.0, 0.0, False), (0.0, 0.0, False)]


@pytest.mark.parametrize("highest", [0, 1])
def test_grades_that_never_occur(spark, docs_of, words, highest):
    rows = [(i, " ".join(words(30, seed=i))) for i in range(60)]
    labels = spark.createDataFrame([(i, 0 if highest == 0 else i % 2, 1 if highest == 0 else i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    if highest == 1:
        labels = spark.createDataFrame([(i, i % 2, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    got = score_quality(docs_of(rows), fit_quality_model(docs_of(rows), labels)).collect()
    assert not any(r.kept for r in got) and max(r.tail_probability for r in got) < 0.05


def test_very_long_text(docs_of, small_model, words):
    got = score_quality(docs_of([(1, " ".join(words(60_000, seed=5))), (2, "x" * 500_000)]), small_model[0]).collect()
    assert all(0 <= r.tail_probability <= 1 for r in got) and len(got) == 2
