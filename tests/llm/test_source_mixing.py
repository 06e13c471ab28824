from collections import defaultdict

import pytest
from llm_cases import SCHEMA
from pyspark.sql import functions as F

from quillon.llm.source_mixing import mix_sources, repeat_documents, word_count


def filled(sizes, weights=(5.0, 2.0, 1.0), epochs=1.5, cap=2.0):
    """Water-filling by hand: sources in code point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = epochs * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def mixed(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    return mix_sources(docs.withColumn("size", word_count(F.col("text"))))


def test_targets_and_taken(spark, words):
    rows = [(i, " ".join(words(5 + i % 40, seed=i)), ["b", "a", "é", "Z", None, "c"][min(i % 9, 5)]) for i in range(600)]
    got = mixed(spark, rows).collect()
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
        assert r.copies <= 2
    assert target == pytest.approx(filled(sizes))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixed(spark, rows[::-1]).collect()
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}


def test_groups_within_a_source(spark, words, monkeypatch):
    monkeypatch.setattr("quillon.llm.source_mixing.GROUP_DOCS", 7)
    rows = [(i, " ".join(words(10, seed=i)), "one" if i % 3 else "two") for i in range(200)]
    for r in mixed(spark, rows).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 5


def test_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "z", "b"), (4, "a b\x0bc", "")]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == [0, 0, 1, 2, 2, 2]
    assert mixed(spark, []).count() == 0
    only_empty = mixed(spark, [(1, "", "a"), (2, None, "b")]).collect()
    assert {(r.target, r.copies) for r in only_empty} == {(0.0, 0)}


def test_repeats_rows(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id long, copies long")
    assert sorted(r.doc_id for r in repeat_documents(rows, ["doc_id"]).collect()) == [2, 3, 3]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 2, "q")], "doc_id long, text string, source string, size long, target string")
    got = mix_sources(docs.withColumnRenamed("target", "_c0")).collect()
    # One source: its target is 1.5 times its size, so of the one document of 2 words 1.5 * 2 - 2 = 1 word is due: half of it, not more.
    assert (got[0].source_size, got[0].target, got[0].copies, got[0]._c0) == (2, 3.0, 1, "q")


def test_rows_without_an_id_are_dealt_to_groups(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.source_mixing.GROUP_DOCS", 10)
    rows = [(None, f"a b {i}", "one") for i in range(300)] + [(i, "x y z", "two") for i in range(100)]
    got = mixed(spark, rows).where("source = 'one'").collect()
    assert abs(sum(r.size * r.copies for r in got) - got[0].target) <= 1.5 and len({r.copies for r in got}) == 2


def test_very_long_text(spark, words):
    rows = [(1, " ".join(words(50_000, seed=1)), "a"), (2, "x " * 10, "a"), (3, "y" * 400_000, "b")]
    got = {r.doc_id: r for r in mixed(spark, rows).collect()}
    assert (got[1].size, got[2].size, got[3].size) == (50_000, 10, 1) and all(r.copies <= 2 for r in got.values())
