from llm_cases import EDGES

from quillon.llm.substring_dedup import repeated_paths, substring_dedup


def brute(rows, k=13):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        out[i] = (len(w), len(gone), " ".join(x.decode() for j, x in enumerate(w) if j not in gone))
    return out


def test_equals_brute_force(docs_of, words):
    shared = [words(n, seed=500 + n) for n in (12, 13, 14, 40, 90)]
    rows = []
    for i in range(40):
        text = words(60, seed=i)
        for j, passage in enumerate(shared):
            if (i + j) % 4 == 0:
                at = (i * 7 + j * 11) % 60
                text = text[:at] + passage + text[at:]
        rows.append((i, " ".join(text)))
    rows += [(50, rows[3][1]), (51, rows[3][1] + " tail"), (52, " ".join(["x", "y"] * 40)), (53, " ".join(["y", "x"] * 30))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_paths_are_whole_passages(docs_of, words):
    passage = words(50, seed=1)
    rows = [(i, " ".join(words(20, seed=10 + i) + passage + words(20, seed=30 + i))) for i in range(3)]
    got = sorted((r.doc_id, r.start, r.n_words, r.source_doc, r.source_start) for r in repeated_paths(docs_of(rows)).collect())
    assert got == [(1, 20, 50, 0, 20), (2, 20, 50, 0, 20)]


def brute_paths(rows, k=13):
    """Walks each text window by window; a path ends where the source does, or where some text goes on along other edges."""
    words = {i: t.encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), (i, j))
    reads = {i: [first[tuple(w[j : j + k])] for j in range(len(w) - k + 1)] for i, w in words.items()}
    cut = set()
    for i, own in reads.items():
        for (d, p), (e, q) in zip(own, own[1:], strict=False):
            if d < i and e < i and (e, q) != (d, p + 1):
                cut |= {(d, p + 1), (e, q)}
    out = []
    for i, own in reads.items():
        last = None
        for j, (d, p) in enumerate(own):
            if d < i:
                if last == (d, p - 1) and (d, p) not in cut:
                    out[-1][2] += 1
                else:
                    out.append([i, j, k, d, p])
            last = (d, p) if d < i else None
    return sorted(map(tuple, out))


def test_branching_graph_equals_brute_force(docs_of, words):
    a, b, c, d = (words(n, seed=60 + n) for n in (40, 45, 55, 70))
    rows = [a + b, a + c, d + b, a + c + words(5, seed=1), d[:30] + c, d + b + a, words(9, seed=2) + a[5:] + c[:33], b[:20] + d[40:]]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = sorted((r.doc_id, r.start, r.n_words, r.source_doc, r.source_start) for r in repeated_paths(docs_of(rows)).collect())
    assert got == brute_paths(rows) and len(got) > 10
    text = {i: t.split() for i, t in rows}
    assert all(text[i][s : s + n] == text[e][p : p + n] for i, s, n, e, p in got)


def test_passage_repeated_within_its_source(docs_of, words):
    a = words(60, seed=8)
    rows = [(0, " ".join(a + a)), (1, " ".join(a)), (2, " ".join(a + words(20, seed=9) + a))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_very_long_text(docs_of, words):
    long = words(40_000, seed=3)
    rows = [(1, " ".join(long)), (2, " ".join(long[10:30_000])), (3, "z" * 500_000), (4, " ".join(["a"] * 30_000))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs_of(rows)).collect()}
    assert got == {1: (40_000, 0), 2: (29_990, 29_990), 3: (1, 0), 4: (30_000, 0)}


def test_edges(docs_of, words):
    text = " ".join(words(30))
    rows = [*EDGES, (7, text), (7, text), (8, text), (None, text)]
    got = substring_dedup(docs_of(rows)).collect()
    assert len(got) == len(rows)
    removed = sorted((r.doc_id, r.n_removed) for r in got if r.doc_id is not None)
    assert removed == [(1, 0), (2, 0), (3, 0), (4, 0), (4, 0), (5, 0), (7, 0), (7, 0), (8, 30)]
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substring_dedup(docs_of([])).count() == 0


def test_two_texts_under_one_id(docs_of, words):
    a, b = " ".join(words(30, seed=1)), " ".join(words(40, seed=2))
    got = substring_dedup(docs_of([(1, a), (2, a + " x"), (2, b)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 30, 0), (2, 31, 30), (2, 40, 0)]
    c, d = " ".join(words(70, seed=3)), " ".join(words(80, seed=4))
    got = substring_dedup(docs_of([(1, c), (1, d), (2, c + " x"), (3, "y " + d)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 70, 0), (1, 80, 0), (2, 71, 70), (3, 81, 80)]


def test_a_span_from_two_texts_of_one_source(docs_of, words):
    """Windows of one passage that stand in different texts under one doc_id."""
    w = words(100, seed=5)
    first, second = w[:60] + words(20, seed=6), words(20, seed=7) + w[48:]
    got = substring_dedup(docs_of([(1, " ".join(first)), (1, " ".join(second)), (2, " ".join(w)), (3, " ".join(w + first))])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 72, 0), (1, 80, 0), (2, 100, 100), (3, 180, 180)]


def test_blocks_that_differ_from_their_source_stay():
    """A long span counts block by block; the rest of it still counts."""
    from quillon.llm.substring_dedup import BLOCK_WORDS, _blocks, _confirmed

    own = [str(i).encode() for i in range(5 * BLOCK_WORDS)]
    other = list(own)
    other[BLOCK_WORDS + 3] = b"different"
    cut = {"start": 0, "end": len(own), "source_doc": 1, "source_start": 7}
    assert _confirmed(cut | {"digests": _blocks(own)}, own, 13) == [{"start": 0, "end": len(own), "source_doc": 1, "source_start": 7}]
    parts = _confirmed(cut | {"digests": _blocks(other)}, own, 13)
    assert [(p["start"], p["end"], p["source_start"]) for p in parts] == [(0, BLOCK_WORDS, 7), (2 * BLOCK_WORDS, len(own), 7 + 2 * BLOCK_WORDS)]
    assert [(p["start"], p["end"]) for p in _confirmed(cut | {"digests": None}, own, 13)] == [(0, len(own))]


def test_clashing_columns(docs_of, words):
    docs = docs_of([(1, " ".join(words(20))), (2, " ".join(words(20)))]).selectExpr("*", "1 AS edge", "2 AS version", "3 AS spans")
    assert sorted(r.n_removed for r in substring_dedup(docs).collect()) == [0, 20]
