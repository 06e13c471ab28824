import math
import random
from collections import Counter

from llm_cases import EDGES, SCHEMA, SMALL

from quillon.llm.quality_rules import common_words, quality_rules


def base(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n = len(words)
    return (
        n,
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def rows_of(df):
    return [
        (r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r) for r in df.collect()
    ]


def test_base_counts(spark, docs_of, words):
    rows = [(i, " ".join(words(n, seed=i))) for i, n in enumerate((4, 5, 6, 30, 400))]
    rows += [(10, "a b c d e " * 3), (11, "x y x y x y x"), (12, "l #1\nl #1\n\n \n\nl #1 \nm|n<>"), (13, "é ü\tß\x0b&&"), (14, "w " * 6)]
    for i, got, _ in rows_of(quality_rules(docs_of(rows))):
        assert got == base(dict(rows)[i]), i


def test_sample_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, got, row in rows_of(quality_rules(docs)):
        assert got == base(texts[i])
        assert row.kept <= (not row.base_failed)


def test_distances_against_hand_computation(spark, docs_of):
    texts = [(1, "the cat sat on the mat and then it ran " * 3), (2, "the dog ate a bone in the house of cards " * 3), (3, "ABC DEF GHI JKL 123 456 ### $$$ @@@ %%% " * 3)]
    docs = docs_of(texts)
    top = common_words(docs.select("text", "lang")).first()
    counts = Counter(w for _, t in texts for w in t.split())
    total = sum(counts.values())
    assert list(top.common) == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20]]
    got = {i: r for i, _, r in rows_of(quality_rules(docs, least_words=10, max_char_distance=0.4))}

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return math.sqrt((kl(p) + kl(q)) / 2)

    def histogram(own, n):
        shares = [own[w] / n for w in top.common]
        return [*shares, max(1 - sum(shares), 0)]

    for i, t in texts:
        own = Counter(t.split())
        assert abs(got[i].word_distance - js(histogram(own, sum(own.values())), histogram(counts, total))) < 1e-6
    assert got[3].char_distance > got[1].char_distance


def test_texts_of_another_language_or_none_are_not_kept(spark, words):
    # "c" shares half of its common words with "b".
    common = {"a": [f"a{'x' * i}" for i in range(20)], "b": [f"b{'x' * i}" for i in range(20)]}
    common["c"] = common["b"][::2] + [f"c{'x' * i}" for i in range(10)]

    def text(lang, seed):
        rng = random.Random(seed)
        rare = words(150, seed)
        return " ".join(rng.choice(common[lang]) if lang and rng.random() < 0.25 else w for w in rare)

    rows = [(lang, lang) for lang in common for _ in range(60)] + [(lang, label) for lang in (*common, None) for label in common if lang != label]
    docs = [(i, text(lang, i), label, "s", 0) for i, (lang, label) in enumerate(rows)]
    for r in quality_rules(spark.createDataFrame(docs, SCHEMA)).collect():
        lang, label = rows[r.doc_id]
        assert r.kept == (lang == label), (lang, label, r)


def test_two_labels_of_one_language_are_kept(spark, words):
    common = [f"a{'x' * i}" for i in range(20)]
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.25 else w for w in words(150, i)), f"en{i % 2}", "s", 0) for i in range(200)]
    assert all(r.kept for r in quality_rules(spark.createDataFrame(docs, SCHEMA)).collect())


def test_edges(docs_of, words):
    long = " ".join(words(20_000, seed=4))
    got = quality_rules(docs_of([*EDGES, (9, long)])).collect()
    assert len(got) == len(EDGES) + 1
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.base_failed, r.kept, r.char_distance) == (0, True, False, None)
    assert quality_rules(docs_of([])).count() == 0
    no_lang = docs_of([(1, " ".join(words(60)))], lang=None).selectExpr("*", "1 AS common", "2 AS n_upper")
    assert quality_rules(no_lang).first().kept


def test_common_words_are_found_by_hash(spark):
    """Short lists hold each common word once; exactly these words are found, and no list is long."""
    from pyspark.sql import functions as F

    from quillon.llm.quality_rules import is_common, word_references

    listed = [[f"w{i}é" for i in range(60)], [f"w{i}é" for i in range(50, 70)], []]
    common = spark.createDataFrame([(str(k), w, [0.01] * len(w)) for k, w in enumerate(listed)], "lang string, common array<string>, common_share array<double>")
    refs = word_references(common)
    row = refs.first()
    assert sorted(w for s in row._slots for w in s) == row._every == sorted({w for own in listed for w in own})
    assert max(map(len, row._slots)) <= 5
    asked = [f"w{i}é" for i in range(-5, 80)] + ["", "W1é", "w1"]
    found = spark.createDataFrame([(w,) for w in asked], "w string").crossJoin(refs).where(is_common(F.col("w"))).collect()
    assert sorted(r.w for r in found) == row._every
    none = word_references(common.limit(0))
    assert none.first()._slots == [[]] and none.select(is_common(F.lit("a")).alias("x")).first().x is False


def test_character_classes_of_odd_texts(spark, docs_of):
    """Symbols and words' characters among lower-case letters, capitals, digits and signs of many alphabets."""
    odd = ["abcz{az`", "ÀÉß ſ ı k", "٣4५ x%y|z", "a#b*c$d%e&f|g<h>i", "🙂a𝐀b c d", "zzz", "a\x0bz\x1cz", "ABC-xyz_[]\\^", "\x00a\x7f"]
    got = {i: g for i, g, _ in rows_of(quality_rules(docs_of(list(enumerate(odd)))))}
    assert got == {i: base(t) for i, t in enumerate(odd)}
