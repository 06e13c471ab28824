import pytest
from llm_cases import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.ngram_jaccard_join import ngram_jaccard_join


def staged(spark, tmp_path, docs, name, sf_dir=SMALL):
    stage = dict(corpus_pipeline.STAGES)[name]
    path = str(tmp_path / name.replace(" ", "_"))
    stage(spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = staged(spark, tmp_path, docs, names[0])
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    bad = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert len(bad) <= 1
    once = staged(spark, tmp_path, kept, names[1])
    groups = {r.doc_id: r.class_id for r in ngram_jaccard_join(kept).collect()}
    assert sorted(r.doc_id for r in once.collect()) == sorted({c for c in groups.values()})
    masked = staged(spark, tmp_path, once, names[2])
    assert masked.count() == once.count()
    mixed = staged(spark, tmp_path, masked, names[3])
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = staged(spark, tmp_path, mixed, names[4])
    assert packed.select("sequence_id", "offset").distinct().count() == packed.count()


def test_near_duplicates_stage_on_repeated_rows(spark, docs_of, words):
    a, b = " ".join(words(30, seed=1)), " ".join(words(30, seed=2))
    docs = docs_of([(5, a), (5, a), (3, a), (7, b), (7, b), (None, a), (8, None), (9, "")])
    got = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, SMALL)
    assert sorted(r.doc_id for r in got.collect()) == [3, 7, 8, 9]


def test_near_duplicates_stage_decides_by_row(spark, docs_of, words):
    a, b, c, d = (" ".join(words(30, seed=s)) for s in range(4))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, d), (None, d), (None, a), (4, None), (4, None), (None, "")]
    rows += [(None, t) for t in (" ".join(words(40, seed=9)), " ".join(words(40, seed=9)))]
    docs = docs_of(rows).selectExpr("*", "1 AS _id", "2 AS _digest", "3 AS row", "map('a', 1) AS digest")
    got = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, SMALL)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == sorted([(1, a), (2, b), (3, c), (3, d), (4, ""), (4, ""), (0, ""), (0, " ".join(words(40, seed=9)))])


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    pieces = got.select("sequence_id", "offset", "length").collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces) > 0
    filled = {}
    for p in pieces:
        filled[p.sequence_id] = filled.get(p.sequence_id, 0) + p.length
    assert all(filled[s] == 2048 for s in range(len(filled) - 1))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[1:]])
def test_empty_table(spark, docs_of, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs_of([]), SMALL).count() == 0
