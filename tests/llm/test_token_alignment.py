import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import EDGES, SMALL

from quillon.llm import token_alignment
from quillon.llm.packing import vocabulary_path
from quillon.llm.token_alignment import align, align_tokens

HARD = [
    "Don't STOP we'll they're 12ab34 x'S  two  spaces\t\ttabs \n\n lines \n end ",
    "carriage\r\nreturn; }\r\n \r x",
    "Ünïcode ŒUVRE Straße ﬁ İstanbul ΑΣ 日本語 テスト 😀👍🏽 a‍b ½",
    "<|endoftext|> <s> </s> <unk> <0x41> x<|endoftext|>Y",
    "no break  x y  z　　 w \u0085 v u",
    "with ▁ a sign of spaces",
    "▁",
    " leading",
    "   \n ",
    "\n\nstart",
    "\x1cfile\x1d \x00 null \x7f \x0b\x0c",
    "''' 's'S 've",
    "a" * 50,
]


@pytest.fixture(scope="module")
def tokenizers():
    """Each text's tokens as (id, bytes), by A and by B, from the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a" and bytes([signs["Ġ"]]) == b" "

    def of_a(text):
        return [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        out = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            out.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        return out

    return of_a, of_b


def brute(rows, tokenizers):
    """Token by token over byte offsets."""
    of_a, of_b = tokenizers
    found, held = [], Counter()
    for i, text in rows:
        a, b = (of(text) if text else [] for of in (of_a, of_b))
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append((i, [], [], "", []))
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for t, raw in tokens:
                out.append((t, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links = [(s[0], t[0]) for s in spans[0] for t in spans[1] if s[1] < t[2] and t[1] < s[2]] if len(whole) < 5000 else None
        cuts = sorted({s[2] for s in spans[0]} & {t[2] for t in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(s[0]) for s in own if start < s[2] <= cut) for own in spans))
            start = cut
        held.update(set(links))
        found.append((i, a, b, ";".join(groups), links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(
        (
            (i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            for i, a, b, groups, links in found
        ),
        key=str,
    )


def got(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_equals_brute_force(docs_of, words, tokenizers):
    rows = [(i - 3, t) for i, t in enumerate(HARD)] + [(100 + i, " ".join(words(n, seed=i))) for i, n in enumerate((1, 300, 3, 90))]
    assert got(align_tokens(docs_of(rows + [(900, rows[-1][1])]).repartition(3))) == brute(rows + [(900, rows[-1][1])], tokenizers)


def test_bundles_and_salts(docs_of, words, tokenizers, monkeypatch):
    """Counts come from all bundles; each looks up its own pairs."""
    monkeypatch.setattr(token_alignment, "GROUP_BYTES", 700)
    rows = [(i, " ".join(words(40, seed=i % 9))) for i in range(40)]
    assert got(align_tokens(docs_of(rows).repartition(2))) == brute(rows, tokenizers)


def test_sample_documents_with_clashing_columns(spark, tokenizers):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("n_chars < 2500").select("doc_id", "text").collect()]
    assert got(align_tokens(docs.where("n_chars < 2500").selectExpr("*", "1 AS bundle", "2 AS codes", "3 AS n_a"))) == brute(rows, tokenizers)


def test_edges(docs_of, tokenizers):
    assert got(align_tokens(docs_of(EDGES))) == brute(EDGES, tokenizers)
    assert got(align_tokens(docs_of([(1, None), (2, "▁")]))) == brute([(1, None), (2, "▁")], tokenizers)
    assert align_tokens(docs_of([])).collect() == []


def test_one_very_long_text(docs_of, words, tokenizers):
    """Token counts and groups of long texts; their links by the sizes of groups."""
    of_a, of_b = tokenizers
    for text in (" ".join(words(40_000, seed=1)), "y" * 100_000, "x\r\n" * 20_000):
        row = align_tokens(docs_of([(1, text)])).first()
        a, b = of_a(text), of_b(text)
        ends = [np.cumsum([len(x) for _, x in t]) for t in (a, b)]
        assert (row.n_a, row.n_b, row.n_groups) == (len(a), len(b), len(set(ends[0]) & set(ends[1])))
        assert row.n_links == len(a) + len(b) - row.n_groups and row.count_sum == row.n_links


def test_tables_that_start_anew(monkeypatch, docs_of, words, tokenizers):
    monkeypatch.setattr(token_alignment.UnitLinks, "limit", 20)
    monkeypatch.setattr(token_alignment, "RUN_BYTES", 300)
    rows = [(i, " ".join(words(40, seed=i))) for i in range(12)]
    assert got(align_tokens(docs_of(rows))) == brute(rows, tokenizers)


def test_align():
    cuts, a_group, b_group, a, b = align(np.array([2, 5, 6, 9]), np.array([1, 2, 4, 6, 9]))
    assert cuts.tolist() == [2, 6, 9] and a_group.tolist() == [0, 1, 1, 2] and b_group.tolist() == [0, 0, 1, 1, 2]
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 3), (3, 4)]
