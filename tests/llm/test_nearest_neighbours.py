import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import nearest_neighbours as nearest
from quillon.llm.nearest_neighbours import Hashing, fit_hashing, nearest_neighbours


def frame(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")


def exact(rows, queries, k=10):
    rows = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    out = {}
    for q in queries:
        far = sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = far[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in w}) / len(w) for q, w in want.items()])


def test_recall_on_the_sample_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = found(nearest_neighbours(vectors, F.col("vec_id") % 100 == 0))
    want = exact(rows, [i for i, _ in rows if i % 100 == 0])
    assert recall(got, want) >= 0.9
    for q, own in got.items():
        assert len(own) == 10 and own == sorted(own)
        scores = dict((i, s) for s, i in exact(rows, [q], k=len(rows))[q])
        assert all(s == pytest.approx(scores[i], rel=1e-12) for s, i in own)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, base[i % 40 if i % 3 else 0].tolist()) for i in range(300)]
    got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0, recall=0.99999))  # what is tested is the order
    want = exact(rows, range(0, 300, 50))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.nearest_neighbours.BLOCK_ROWS", 16)
    monkeypatch.setattr("quillon.llm.nearest_neighbours.BLOCK_QUERIES", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 0.01 + 1).tolist()) for i in range(200)]
    got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, recall=0.99999))
    assert recall(got, exact(rows, range(0, 200, 10))) == 1


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 5.0]), (2, [-9.0, 1.0])]
    got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") == 0))
    assert [i for _, i in got[0]] == [1, 2]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [4.0, 4.0])]
    docs = frame(spark, rows).selectExpr("*", "1 AS id", "2 AS bucket", "3 AS raw")
    got = found(nearest_neighbours(docs, F.coalesce(F.col("vec_id") >= 0, F.lit(False))))
    assert {q: [i for _, i in v] for q, v in got.items()} == {0: [7, 100], 7: [0, 100], 100: [0, 7]}
    assert nearest_neighbours(frame(spark, []), F.col("vec_id") >= 0).count() == 0
    assert nearest_neighbours(frame(spark, [(1, [1.0])]), F.col("vec_id") >= 0).count() == 0


def test_probes_come_in_order_of_success():
    hashing: Hashing = fit_hashing(np.random.default_rng(3).normal(size=(50, 6)), 50, 2, 100, 5, 0.9, 1)
    cells = hashing.cells(np.random.default_rng(4).normal(size=(1, 6)))[:, 0]
    probes = hashing.probes(cells, 20)
    assert len(probes) == 40 and probes[0] % 2**64 == int(hashing.buckets(cells[:, None, :])[0, 0])
    assert len({p % 2**64 for p in probes[:20]}) == 20


def test_perturbations_are_in_order():
    below = np.random.default_rng(5).uniform(0, 1, 5)
    listed = nearest.perturbations(below, 3**5)
    cost = [sum((below[i] if s < 0 else 1 - below[i]) ** 2 for i, s in moves) for moves in listed]
    assert len({frozenset(m) for m in listed}) == 3**5 and cost == sorted(cost)


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 25, 16))
    return [(i, (centres[i % len(centres)] + 0.1 * rng.normal(size=16)).tolist()) for i in range(n)]


@pytest.mark.parametrize("n", [1000, 6000])
def test_clustered_vectors_meet_few_others(spark, n, monkeypatch):
    """Recall of 0.9 at two sizes, by the index alone, with a bounded share of all rows in the visited buckets."""
    rows = clusters(n, seed=n)
    queries = [i for i in range(0, n, 100)]
    got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert recall(got, exact(rows, queries)) >= 0.9
    x = np.array([v for _, v in rows])
    hashing = fit_hashing(x[:4096], n, 16, 100, 10, 0.97, 1)
    buckets = hashing.buckets(hashing.cells(x))
    shares = []
    for q in queries:
        visited = np.array([p % 2**64 for p in hashing.probes(hashing.cells(x[[q]])[:, 0], 100)], dtype=np.uint64).reshape(16, 100)
        shares.append(np.mean(np.any([np.isin(buckets[t], visited[t]) for t in range(16)], axis=0)))
    assert np.mean(shares) < 0.06


def test_two_vectors_under_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [5.0, 5.0]), (1, [1.0, 1.0]), (2, [9.0, 9.0]), (2, [2.0, 0.0])]
    got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") == 0))
    assert got == {0: [(1.0, 1), (1.0, 2)]}


def test_exact_blocks_follow_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 20)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 10)
    rows = spark.range(4000).selectExpr("id", "array(float(id), 0f) AS vec")
    dealt = nearest._dealt_with_all(rows.where("id % 100 = 0"), rows)
    blocks = dealt.groupBy("bx", "bq").agg({"id": "count"}).collect()
    assert len(blocks) == 200 * 4 and max(r[2] for r in blocks) < 100
    pairs = dealt.where("is_query").alias("q").join(dealt.where("not is_query").alias("x"), ["bucket", "bx", "bq"])
    assert pairs.count() == pairs.select("q.id", "x.id").distinct().count() == 40 * 4000
