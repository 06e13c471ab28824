import zlib

import numpy as np
import pytest
from llm_cases import EDGES, SMALL

from quillon.llm._stage import release, shared_dir
from quillon.llm.packing import vocabulary_path
from quillon.llm.token_files import document_ids, mounted, read_token_files, token_files, write_token_files

HARD = [
    "Don't STOP we'll they're 12ab34 x'S  two  spaces\t\ttabs \n\n lines \r\n end ",
    "Ünïcode ŒUVRE Straße ﬁ İstanbul ΑΣ 日本語 テスト 😀👍🏽 a‍b ½",
    "<|endoftext|> x<|endoftext|>Y <|ENDOFTEXT|> <|endoftext |>",
    "no break  x y  z　　 w \u0085 v u",
    "\x1cfile\x1d \x00 null \x7f \x0b\x0c",
    "   \n ",
    "\n\nstart",
    "'''' 's'S 've",
]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]


def brute(rows, encode):
    """Documents in order, by the tokenizer alone; rows of one doc_id in any order."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_equals_the_tokenizer(docs_of, words, encode):
    rows = [(i - 3, t) for i, t in enumerate(HARD)] + [(100 + i, " ".join(words(n, seed=i))) for i, n in enumerate((1, 700, 3, 90))]
    assert got(token_files(docs_of(rows[::-1]).repartition(3))) == brute(rows, encode)


def test_sample_documents_with_clashing_columns(spark, encode):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(token_files(docs.selectExpr("*", "1 AS part", "2 AS base", "3 AS n_tokens"))) == brute(rows, encode)


def test_edges(docs_of, encode):
    """Rows of one doc_id follow each other; null ids come first; repeated rows are written each."""
    found, want = got(token_files(docs_of(EDGES))), brute(EDGES, encode)
    assert [r[0] for r in found] == [r[0] for r in want]
    assert sorted((r[2], r[3]) for r in found) == sorted((r[2], r[3]) for r in want)
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()
    assert token_files(docs_of([])).collect() == []


def test_one_doc_id_holds_most_rows(spark, docs_of, words, encode):
    rows = [(7, " ".join(words(20, seed=i))) for i in range(300)] + [(i, "x y") for i in range(20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = token_files(docs_of(rows).repartition(4))
        rows_of = [r[0] for r in got(found)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows_of == sorted(rows_of) and sum(r[2] for r in got(found)) == sum(len(encode(t)) for _, t in rows)


def test_one_very_long_text(docs_of, words, encode):
    rows = [(1, " ".join(words(60_000, seed=1))), (2, "y" * 300_000), (3, "z " * 5_000)]
    assert got(token_files(docs_of(rows))) == brute(rows, encode)


def test_files_are_flat_and_mapped(spark, docs_of, encode, tmp_path):
    rows = [(5, "five five"), (None, "none"), (2, "two <|endoftext|>")]
    write_token_files(docs_of(rows).coalesce(1), f"file://{tmp_path}/out")
    parts = spark.read.parquet(f"{tmp_path}/out/manifest").orderBy("part").collect()
    every = np.concatenate([np.fromfile(f"{tmp_path}/out/part-{p.part:06d}.ids", dtype="<u2") for p in parts])
    assert every.tolist() == encode("none") + encode("two <|endoftext|>") + encode("five five")
    assert [p.base for p in parts] == np.cumsum([0, *(p.n_tokens for p in parts)])[:-1].tolist()
    assert sum(p.n_null for p in parts) == 1 and not list(tmp_path.glob("out/*.tmp"))
    one = document_ids(f"{tmp_path}/out", parts[0].part, 0)
    assert isinstance(one, np.memmap) and one.tolist() == encode("none")
    with pytest.raises(FileExistsError):
        write_token_files(docs_of(rows), f"file://{tmp_path}/out")


def test_a_task_that_runs_again_leaves_the_same_files(spark, docs_of, tmp_path):
    """Two attempts of one part write apart and rename; a failed one leaves nothing."""
    from quillon.llm.token_files import _Part

    import pyarrow as pa

    first, again, failed = (_Part(str(tmp_path), 3) for _ in range(3))
    for part in (first, again, failed):
        part.write(pa.array([1, None], pa.int64()), np.array([2, 1]), np.array([1, 0, 0], dtype="<u2"))
    first.publish()
    again.publish()
    failed.abandon()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["part-000003.docs", "part-000003.ids", "part-000003.offsets"]
    assert np.fromfile(tmp_path / "part-000003.offsets", dtype="<i8").tolist() == [0, 2, 3]


def test_tables_that_start_anew(monkeypatch, docs_of, words, encode):
    from quillon.llm import token_files as module

    monkeypatch.setattr(module.UnitIds, "limit", 20)
    monkeypatch.setattr(module, "RUN_BYTES", 300)
    rows = [(i, " ".join(words(40, seed=i)) + HARD[i % len(HARD)]) for i in range(12)]
    assert got(token_files(docs_of(rows))) == brute(rows, encode)


def test_other_vocabularies_are_refused():
    from quillon.llm.token_files import UnitIds

    with pytest.raises(ValueError, match="rules"):
        UnitIds(vocabulary_path("word_bpe_49k.json"))


def test_release_removes_the_files(spark, docs_of):
    found = token_files(docs_of([(1, "one")]))
    assert found.count() == 1
    folder = mounted(shared_dir(spark)) / "quillon"
    assert list(folder.glob("token-files-*"))
    release(spark)
    assert not list(folder.glob("token-files-*"))


def test_folders_that_are_not_mounted_are_refused():
    with pytest.raises(ValueError, match="mounted"):
        mounted("hdfs://host/out")


def test_broken_files_are_told(spark, docs_of, tmp_path):
    write_token_files(docs_of([(1, "one two")]), f"{tmp_path}/out")
    ids = next((tmp_path / "out").glob("*.ids"))
    ids.write_bytes(ids.read_bytes()[:-2])
    with pytest.raises(Exception, match="fit together"):
        read_token_files(spark, f"{tmp_path}/out").collect()
