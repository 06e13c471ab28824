"""Packing: concatenate all token ids and cut fixed windows, by prefix sums in two passes."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import small_batches, staged, worker_state
from ._units import BYTE_SIGNS
from ._words import Texts, Words


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts are tokenized in runs of about this many bytes, so that words repeat within one.
RUN_BYTES = 1 << 20
#: The vocabulary's own split of lower-case words: contractions, letters, single digits, other signs.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+|\n")
#: Words that split and lower-case like this: printable ASCII, and Latin-1 letters.
PLAIN = re.compile(r"[!-~\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class Pieces(dict):
    """piece -> its ids as bytes; the tokenizer's BPE model is asked for new ones."""

    def __init__(self, model, kind: str) -> None:
        super().__init__({"\n": b""})
        self.model, self.sign = model, "H" if kind == "<u2" else "I"

    def __missing__(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else "".join(BYTE_SIGNS[b] for b in piece.encode())
        ids = [t.id for t in self.model.tokenize(signs)]
        value = self[piece] = struct.pack(f"<{len(ids)}{self.sign}", *ids)
        return value


class WordTokens:
    """Token ids word by word: the vocabulary's rules never join what white space parts, so a text's ids are its words' ids.

    Each different word of a run of texts, told by its 64-bit hash, is looked up
    once.  New words of ASCII and Latin-1 letters are split into pieces for the
    tokenizer's BPE model; all others, and words that hold one of its special
    tokens, go to the whole tokenizer.  Ids of up to ``limit`` words and as many
    pieces are kept.  A vocabulary that splits texts by other rules is refused.
    """

    limit = 500_000
    # Words on which vocabularies of other rules differ.
    probes = ("Don't", "they'll", "12ab34", "x'S", "Stra\u00dfe", "a+b=c", "''s", "\u00bd", "MiXeD", "_a_")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()
        whole = self.tokenizer.encode(" ".join(self.probes), add_special_tokens=False).ids
        words = b"".join(self._look_up_words("\n".join(self.probes)))
        if np.frombuffer(words, dtype=self.kind).tolist() != whole:
            raise ValueError(f"the vocabulary in {path} does not split texts into words by the rules known here")

    def _clear(self) -> None:
        self.known: dict[int, bytes] = {}
        self.pieces = Pieces(self.tokenizer.model, self.kind)

    def _by_pieces(self, text: str) -> list[bytes]:
        """The ids of each line's word, in lower case."""
        found = PIECES.findall(text.lower())
        if len(self.pieces) > self.limit:
            self.pieces = Pieces(self.tokenizer.model, self.kind)
        out, own = [], b""
        for ids in map(self.pieces.__getitem__, found):
            if ids:
                own += ids
            else:
                out.append(own)
                own = b""
        out.append(own)
        return out

    def _look_up(self, words: Words, which: np.ndarray) -> list[bytes]:
        return self._look_up_words(words.joined(which).decode())

    def _look_up_words(self, text: str) -> list[bytes]:
        """The ids of each line's word."""
        special = [s for s in self.special if s in text]
        if not special and PLAIN.fullmatch(text):
            return self._by_pieces(text)
        split = text.split("\n")
        plain = [PLAIN.fullmatch(w) is not None and not any(s in w for s in special) for w in split]
        easy = [w for w, p in zip(split, plain, strict=True) if p]
        found = iter(self._by_pieces("\n".join(easy)) if easy else [])
        rest = iter(self._whole([w for w, p in zip(split, plain, strict=True) if not p]))
        return [next(found) if p else next(rest) for p in plain]

    def _whole(self, split: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(split, add_special_tokens=False) if split else []
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def of(self, words: Words, end_id: int) -> list[bytes]:
        """The ids of each text as little-endian integers, followed by ``end_id``."""
        end = np.array([end_id], dtype=self.kind).tobytes()
        keys, where, at = np.unique(words.hashes, return_index=True, return_inverse=True)
        keys = keys.tolist()
        if len(self.known) > self.limit:
            self.known = {}
        ids = list(map(self.known.get, keys))
        fresh = [i for i, x in enumerate(ids) if x is None]
        if fresh:
            for i, found in zip(fresh, self._look_up(words, where[fresh]), strict=True):
                ids[i] = self.known[keys[i]] = found
        every = list(map(ids.__getitem__, at.tolist()))
        stops = np.cumsum(words.counts).tolist()
        return [b"".join(every[a:b]) + end for a, b in zip([0, *stops], stops, strict=False)]


def _tokenize(path: str, end_id: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches):
        kept = worker_state("packing")
        if (tokens := kept.get(path)) is None:
            tokens = kept[path] = WordTokens(path)
        before, wide = 0, int(tokens.kind[-1])
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts = Texts(batch.column("text"))
            for a, b in texts.runs(RUN_BYTES):
                ids = tokens.of(texts.words(a, b), end_id)
                counts = np.array([len(i) // wide for i in ids], dtype=np.int64)
                places = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([part] * (b - a), pa.int32()),
                        pa.array(places),
                        pa.array(counts),
                        pa.array(ids, pa.binary()),
                    ],
                    schema=schema,
                )

    return run


_PIECE = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("ids", pa.binary()),
]


def _cut(size: int):
    schema = pa.schema(_PIECE)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, at, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "doc_tokens", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * total else "<u4").astype("<u4")
                start = 0
                while start < total:
                    sequence, offset = divmod(at + start, size)
                    length = min(size - offset, total - start)
                    piece = ids[start : start + length].tobytes()
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, sequence, offset, piece))
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=schema
                )

    return run


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 1) -> DataFrame:
    """All documents' token ids, each followed by ``end_id``, laid end to end and cut into sequences of ``size``.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids`` (little-endian unsigned 32-bit).  Every sequence
    but the last is full, so padding is at most ``size - 1`` tokens in all.

    First pass: tasks write their documents' ids with the tokens before each
    within the task; the totals of the tasks' partitions are summed up to global
    offsets (a window over one row per partition).  Second pass: offsets cut
    each document where it crosses a window.  The order is that of the input's
    partitions.

    Ids are the tokenizer's own without special tokens added round a text; a
    special token that stands in a text has its own id.  A null or empty text has ``end_id`` alone.  Rows repeated whole are packed
    each; null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
            _tokenize(path or vocabulary_path(), end_id), "doc_id long, part int, before long, doc_tokens long, ids binary"
        ),
        "tokens",
    )
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(totals.select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base")), "bases")
    return (
        tokens.join(bases, "part")
        .select("doc_id", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids")
        .mapInArrow(
            _cut(size),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
        )
    )
