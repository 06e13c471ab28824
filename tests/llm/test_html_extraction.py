import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SMALL

from quillon.llm.html_extraction import Tree, extract_articles, parse, simple_tree_matching

ARTICLE = "<article><header><h1>Title &amp; more</h1></header><p>One\n  two<br>three <a href='/x'>link</a>.<ul><li>a<li>b</ul><p>Last&nbsp;&lt;p&gt;"


def page(body, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body>{before}{body}{after}</body></html>"


def texts(spark, pages):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract_articles(rows).collect()}


def test_article_without_its_surroundings(spark):
    before = "<nav><ul><li><a href=/>Home</a></ul></nav><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><script>var a='<p>no</p>';</script>"
    inside = "<aside>related</aside><div class=comments><article><p>I disagree</p></article></div><form>mail <input></form></article>"
    after = "<div id='sidebar'><p>side</p></div><!-- <p>gone</p> --><footer>&copy; us</footer>"
    got = texts(spark, [("http://a.example/1", page(ARTICLE + inside, before, after))])
    assert got[0] == "Title & more\nOne two three link.\na\nb\nLast <p>"


def test_wrapper_from_varying_slots(spark):
    def plain(i):
        return page(f"<div class=wrap><div class=top>Daily News</div><div class=text><p>Story {i} begins.</p><p>And ends {i}.</p></div><div class=bottom>All rights</div><div class=more><a href=/a>go {i}</a></div></div>")

    got = texts(spark, [(f"http://b.example/{i}", plain(i)) for i in range(4)])
    assert got == {i: f"Story {i} begins.\nAnd ends {i}." for i in range(4)}


def test_shared_passages_stay_in_an_article(spark):
    got = texts(spark, [(f"http://c.example/{i}", page(f"<article><p>Same.</p><p>Own {i}</p></article>")) for i in range(5)])
    assert got[3] == "Same.\nOwn 3"


def test_slots_decide_within_marked_articles(spark):
    def marked(i):
        return page(
            f"<article><p>Story {i}.</p><div class='share-price'>At {i} dollars</div><div class='sign-off'>Read our terms</div>"
            f"<div class='share-box'><a href=/s>send {i}</a></div><div class=ad>Buy {i}</div><ul><li><a href=/r>Source {i}</a></ul></article>"
        )

    got = texts(spark, [(f"http://e.example/{i}", marked(i)) for i in range(4)])
    assert got == {i: f"Story {i}.\nAt {i} dollars\nSource {i}" for i in range(4)}


def test_copies_are_no_evidence_of_a_template(spark):
    copy = page("<div class=text><p>One story.</p></div><blockquote>As said</blockquote>")
    assert set(texts(spark, [(f"http://f.example/{i}", copy) for i in range(5)]).values()) == {"One story.\nAs said"}
    others = [page(f"<div class=text><p>Story {i}.</p></div><div class=end>All rights</div>") for i in range(6)]
    got = texts(spark, [(f"http://g.example/{i}", h) for i, h in enumerate([copy] * 5 + others)])
    assert [got[i] for i in range(11)] == ["One story.\nAs said"] * 5 + [f"Story {i}." for i in range(6)]


def tree(paths):
    """A tree from (parent, label) pairs, the root first."""
    return Tree("\n".join(f"{above} {own}" for above, own in [(0, ""), *paths]))


def test_tree_matching_counts_and_pairs():
    a = tree([(0, "div"), (1, "p"), (1, "ul"), (3, "li"), (1, "p.x")])
    b = tree([(0, "div"), (1, "h1"), (1, "p"), (1, "ul"), (4, "li"), (4, "b")])
    size, pairs = simple_tree_matching(a, b)
    assert size == 5 and sorted(pairs) == [(0, 0), (1, 1), (2, 3), (3, 4), (4, 5)]


def brute_match(a, b, x=0, y=0):
    """The largest order-keeping match of two subtrees, over all ways to pair their children."""
    if a.tags[x] != b.tags[y]:
        return 0
    rows, cols = a.children[x], b.children[y]
    best = 0
    for n in range(min(len(rows), len(cols)) + 1):
        for some in itertools.combinations(rows, n):
            for others in itertools.combinations(cols, n):
                sizes = [brute_match(a, b, r, c) for r, c in zip(some, others, strict=True)]
                if all(sizes):
                    best = max(best, sum(sizes))
    return 1 + best


small_tree = st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["p", "div", "p.x", "ul"])), max_size=7).map(
    lambda own: tree([(min(above, i), name) for i, (above, name) in enumerate(own)])
)


@given(small_tree, small_tree)
@settings(max_examples=300, deadline=None)
def test_tree_matching_equals_brute_force(a, b):
    size, pairs = simple_tree_matching(a, b)
    assert size == len(pairs) == brute_match(a, b)
    assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == size
    assert all(a.tags[x] == b.tags[y] for x, y in pairs)


def test_edges(spark):
    broken = "<p>cut <b>off <div>x<p>y</article></p></b> &unknown; &#65; <a href='never closed"
    got = texts(spark, [(None, None), ("x", ""), ("http://h.example", "no markup at all"), ("http://h.example", broken), ("http://h.example", "<script>only</script>")])
    assert (got[0], got[1], got[2], got[4]) == ("", "", "no markup at all", "")
    assert "cut off" in got[3] and "A" in got[3]
    nested = "<div>" * 3000 + "deep"
    assert parse(nested)[1][0][1] == "deep"
    assert texts(spark, []) == {}


def test_deep_pages_survive(spark):
    def deep(n, end):
        return "<div>" * n + "deep" + end + "</div>" * n

    got = texts(spark, [("http://d.example", deep(5000, "")), ("http://d.example", deep(5000, "<p>er</p>")), ("http://d.example", deep(4000, "<ul><li>x</ul>"))])
    assert got == {0: "deep", 1: "deep\ner", 2: "deep\nx"}


@pytest.mark.parametrize("bit", ["<a ", "<a '", '<a ="', "<p", "<b>", "<i><b></i>", "<!--", "<b>x<p>y", "<script>", "&amp", "<td><b>"])
def test_long_broken_markup_stays_linear(bit):
    began = time.perf_counter()
    parse(bit * (1_000_000 // len(bit)))
    assert time.perf_counter() - began < 30


def test_decided_by_compared_slots(spark):
    rows = [(i, f"http://{i % 2}.example/{i}", page(f"<nav><a href=/>Home {i}</a></nav><div class=text><p>Story {i} begins here.</p></div><div class=x>Terms</div>")) for i in range(8)]
    got = extract_articles(spark.createDataFrame([*rows, (9, "http://single.example", page("<p>Alone.</p>"))], "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.text, r.by_wrapper) for r in got} == {**{i: (f"Story {i} begins here.", True) for i in range(8)}, 9: ("Alone.", False)}


def test_sample_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = extract_articles(pages.selectExpr("*", "1 AS host", "2 AS text")).collect()
    assert len(got) == pages.count() and all(r.text for r in got)
    assert not any("\n\n" in r.text or "<article" in r.text for r in got)


def sisters(names):
    return Tree("\n".join(["0 ", *(f"0 div.{n}" for n in names)]))


def test_many_different_sisters_are_aligned_in_pieces():
    """20,000 sisters of other names on either side, and with some in common: under 5 seconds, in order, common ones matched."""
    rows = [f"a{i}" for i in range(20_000)]
    began = time.perf_counter()
    size, pairs = simple_tree_matching(sisters(rows), sisters([f"b{i}" for i in range(20_000)]))
    assert time.perf_counter() - began < 5 and size == len(pairs) == 20_001  # names differ, tags agree
    mixed = [x for i in range(20_000) for x in ([f"a{i}"] if i % 10 == 0 else [f"c{i}", f"d{i}"])]
    began = time.perf_counter()
    size, pairs = simple_tree_matching(a := sisters(rows), b := sisters(mixed))
    assert time.perf_counter() - began < 5
    matched = {(a.labels[x], b.labels[y]) for x, y in pairs}
    assert all((f"div.a{i}", f"div.a{i}") in matched for i in range(0, 20_000, 10))
    assert [y for _, y in sorted(pairs)] == sorted(y for _, y in pairs)


@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=30))
@settings(max_examples=60, deadline=None)
def test_pieces_keep_order_and_lose_no_sister(rows, cols):
    from quillon.llm import html_extraction as module

    before, module.PIECE_PAIRS = module.PIECE_PAIRS, 20
    try:
        pieces = module.sister_pieces(list(range(len(rows))), list(range(len(cols))), rows, cols)
        size, pairs = simple_tree_matching(sisters(rows), sisters(cols))
    finally:
        module.PIECE_PAIRS = before
    for k in (0, 1):
        listed = [x for p in pieces for x in p[k]]
        assert listed == sorted(set(listed))
    assert size == len(pairs) <= 1 + min(len(rows), len(cols))
    whole = simple_tree_matching(sisters(rows), sisters(cols))[0]
    assert size <= whole


def plain_alignment(a, b):
    """The largest order-keeping match of leaves by tag, and the most equal labels in one of that size: every pair is looked at."""
    best = [(0, 0)] * (len(b.labels))
    for x in range(1, len(a.labels)):
        last, best = best, [(0, 0)]
        for y in range(1, len(b.labels)):
            size, same = last[y - 1]
            taken = (size + 1, same + (a.labels[x] == b.labels[y])) if a.tags[x] == b.tags[y] else (0, 0)
            best.append(max(taken, last[y], best[y - 1]))
    return best[-1]


def mixed_sisters(n, seed):
    rng = random.Random(seed)
    names = [f"{('div', 'p', 'section')[i % 3]}.n{i}" for i in range(n)]
    rng.shuffle(names)
    return tree([(0, x) for x in names])


@pytest.mark.parametrize("n", [60, 250, 300, 420])
def test_sisters_of_any_number_are_aligned_by_one_rule(n):
    a, b = mixed_sisters(n, 1), mixed_sisters(n + 7, 2)
    size, pairs = simple_tree_matching(a, b)
    assert size == len(pairs)
    assert (size - 1, sum(a.labels[x] == b.labels[y] for x, y in pairs if x)) == plain_alignment(a, b)


@given(small_tree, small_tree, st.integers(2, 40))
@settings(max_examples=60, deadline=None)
def test_matches_do_not_depend_on_what_is_held_at_once(a, b, n):
    from quillon.llm import html_extraction as module

    before, lists = module.PIECE_PAIRS, (mixed_sisters(n, 1), mixed_sisters(n + 3, 2))
    whole = [simple_tree_matching(a, b), simple_tree_matching(*lists)]
    try:
        for module.PIECE_PAIRS in (1, 30):
            assert [simple_tree_matching(a, b), simple_tree_matching(*lists)] == whole
    finally:
        module.PIECE_PAIRS = before
