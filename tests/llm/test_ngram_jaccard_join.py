from llm_cases import EDGES

from quillon.llm.components import connected_components
from quillon.llm.ngram_jaccard_join import choose_bands, ngram_jaccard_join


def grams(text, n=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    classes = {}
    for i in sorted(sets):
        if i not in classes:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in classes:
                    classes[x] = i
                    todo += links[x]
    return {i: (classes[i], len(links[i])) for i in sets}


def near(base, words, i):
    out = list(base)
    out[(i * 13) % len(out)] = words(1, seed=900 + i)[0]
    return out


def test_equals_brute_force(docs_of, words):
    rows, i = [], 0
    for family in range(6):
        base = words(120, seed=family)
        for copy in range(8):
            rows.append((i, " ".join(near(base, words, copy) if copy % 3 else base)))
            i += 1
    rows += [(100 + j, " ".join(words(n, seed=50 + j))) for j, n in enumerate((1, 2, 4, 5, 6, 40, 300))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_large_group_spans_blocks(docs_of, words, monkeypatch):
    monkeypatch.setattr("quillon.llm.ngram_jaccard_join.BLOCK", 4)
    base = words(150, seed=3)
    rows = [(i, " ".join(near(base, words, i))) for i in range(22)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_chain_of_pairs(docs_of, words):
    base, rows = words(60, seed=4), []
    for i in range(30):  # each differs from the next by one word; far ones have little in common
        rows.append((i, " ".join(base)))
        base[(2 * i) % 60] = words(1, seed=700 + i)[0]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_rows_without_an_id_take_part(docs_of, words):
    base = words(150, seed=5)
    rows = [(None, " ".join(near(base, words, i))) for i in range(3)] + [(9, " ".join(near(base, words, 3)))]
    got = ngram_jaccard_join(docs_of([*rows, (None, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r.class_id or 0, r.n_links) for r in got) == [(0, 1), (0, 1), *[(9, 3)] * 4]
    assert len({r.group_key for r in got}) == 2


def test_very_long_text(docs_of, words):
    long = words(40_000, seed=6)
    rows = [(1, " ".join(long)), (2, " ".join(long[:39_000])), (3, "z" * 400_000)]
    assert {r.doc_id: r.class_id for r in ngram_jaccard_join(docs_of(rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_edges(spark, docs_of):
    got = ngram_jaccard_join(docs_of(EDGES)).collect()
    assert len(got) == len(EDGES)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by_id[1].n_shingles, by_id[1].class_id, by_id[1].n_links) == (0, 1, 0)
    assert by_id[4].n_links == 1 and by_id[4].class_id == 4
    assert ngram_jaccard_join(docs_of([])).count() == 0


def test_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f")]).selectExpr("*", "1 AS cls", "'x' AS class_id", "2 AS band")
    assert {r.class_id for r in ngram_jaccard_join(docs).collect()} == {1}


def test_bands_reach_their_recall():
    assert 1 - (1 - 0.8**8) ** choose_bands(0.8, 0.9999, 8) >= 0.9999


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(edges.limit(0)).count() == 0
