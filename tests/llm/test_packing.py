import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import EDGES, SMALL

from quillon.llm.packing import WordTokens, pack, vocabulary_path

HARD = [
    "Don't STOP we'll they're 12ab34 x'S",
    "Ünïcode ŒUVRE Straße ﬁ İstanbul ΑΣ",
    "<|endoftext|> <|startoftext|>",
    "hello <|endoftext|> world x<|endoftext|>Y\u00e9<|startoftext|> <|ENDOFTEXT|> <|endoftext |>",
    "é ́a   x\x1cy\x7f\x00",
    "日本語 テスト 😀👍🏽 a‍b",
    "½ ² ª º × ÷ ß",
    "''' 's'S 've",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path())
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, pieces, tokenizer, size):
    want = [tuple(tokenizer(t)) for _, t in rows]
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4")
        assert zlib.crc32(ids.tobytes()) == p.ids_crc32 and len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append((p.start, p.doc_tokens, ids.tolist()))
    lengths = {}
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        lengths[s] = at
    assert all(lengths[s] == size for s in range(len(lengths) - 1))
    for (i, _), ids in zip(rows, want, strict=True):
        if i is not None and [r[0] for r in rows].count(i) == 1:
            parts = sorted(documents[i])
            assert sum((x for _, _, x in parts), []) == list(ids)
            assert {t for _, t, _ in parts} == {len(ids)}
    assert sum(lengths.values()) == sum(map(len, want))


def test_equals_the_tokenizer(spark, docs_of, words, tokenizer):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100 + i, " ".join(words(n, seed=i))) for i, n in enumerate((1, 700, 3, 90))]
    check(rows, pack(docs_of(rows).repartition(3), size=64).collect(), tokenizer, 64)


def test_special_tokens_have_their_own_ids(docs_of):
    got = pack(docs_of([(1, "hello <|endoftext|> world")])).first()
    assert np.frombuffer(got.ids, dtype="<u4").tolist() == [3306, 49407, 1002, 1]


def test_other_vocabularies_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.BPE({c: i for i, c in enumerate(map(chr, range(33, 127)))}, []))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError, match="rules"):
        WordTokens(str(tmp_path / "other.json"))


def test_one_very_long_text(docs_of, words, tokenizer):
    rows = [(1, " ".join(words(60_000, seed=1))), (2, "y" * 300_000)]
    check(rows, pack(docs_of(rows)).collect(), tokenizer, 2048)


def test_edges(docs_of, tokenizer):
    check(EDGES, pack(docs_of(EDGES), size=8).collect(), tokenizer, 8)
    assert pack(docs_of([])).count() == 0


def test_sample_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(rows, pack(docs.selectExpr("*", "1 AS part", "2 AS ids")).collect(), tokenizer, 2048)
