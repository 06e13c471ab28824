"""Cross-tokenizer alignment: where tokens of two vocabularies end together, and how often their ids are linked."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import small_batches, staged, worker_state
from ._units import WIDE_SPACE, ByteLevel, Units, UnitTable
from ._words import Texts, ranges
from .packing import vocabulary_path

#: Texts are tokenized in runs of about this many bytes.
RUN_BYTES = 1 << 20
#: Documents are taken together to count pairs, and to look their counts up, up to about this many bytes of text.
GROUP_BYTES = 1 << 23
#: Shares in which each pair's documents are counted first.
SALTS = 16


class PieceTokens:
    """B: a vocabulary of pieces with bytes to fall back to; it puts a space before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)}
        self.sizes = np.array([len(self.bytes[i]) for i in range(len(self.bytes))], dtype=np.int64)
        self.space = self.model.piece_to_id("▁")

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, and how many each has.

        Of units that begin with a space, the first one is the one that the vocabulary adds (it adds none to nothing);
        else that one is taken off again.
        """
        own = [u.startswith(" ") for u in units]
        found = self.model.encode([u[1:] if o else u for u, o in zip(units, own, strict=True)], num_threads=1)
        found = [(ids or [self.space]) if o else ids[1:] if ids[:1] == [self.space] else [] for ids, o in zip(found, own, strict=True)]
        return np.array([i for ids in found for i in ids], dtype=np.int64), np.array(list(map(len, found)), dtype=np.int64)


def _same_bytes(tokens, ids: np.ndarray, counts: np.ndarray, units: list[bytes]) -> np.ndarray:
    """Whether each unit's tokens stand for its bytes."""
    stops = np.cumsum(counts)
    ends, want = np.append(0, np.cumsum(tokens.sizes[ids]))[stops], np.cumsum(list(map(len, units)))
    found = list(map(tokens.bytes.__getitem__, ids.tolist()))
    if (ends == want).all() and b"".join(found) == b"".join(units):
        return np.ones(len(units), dtype=bool)
    return np.array([b"".join(found[e - n : e]) == u for e, n, u in zip(stops.tolist(), counts.tolist(), units, strict=True)], dtype=bool)


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends of two token sequences over the same bytes, the group of each token, and the linked positions.

    Tokens of one group lie between two common ends.  A token pair is linked
    where its byte ranges overlap; the links are ordered by A token.
    """
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = (np.searchsorted(cuts, ends) for ends in (a_ends, b_ends))
    starts = np.append(0, a_ends[:-1])
    first = np.searchsorted(b_ends, starts, side="right")
    n = np.searchsorted(b_ends, a_ends) - first + 1
    return cuts, a_group, b_group, np.repeat(np.arange(len(a_ends)), n), ranges(first, n)


class UnitLinks(UnitTable):
    """Of each different unit: its tokens by both vocabularies, their groups as text, and the codes of its links.

    Numbers are kept in arrays by unit; codes of all units lie end to end.
    """

    limit = 400_000
    #: Texts with these are one unit: white space that may end a word, carriage returns (pieces join them to words).
    odd = re.compile(WIDE_SPACE + rb"|\r")

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path, special=False), PieceTokens(b_path)
        joined = [t for t in self.b.bytes.values() if re.search(rb"[^\t-\r ][\t-\x0c ]", t)]
        if joined:
            raise ValueError(f"{b_path} has pieces that go on behind a word's end: {joined[:5]}")
        #: A pair's code is its A id times this, plus its B id; codes have as many bytes as that needs.
        self.stride = len(self.b.sizes)
        self.kind = "<u4" if len(self.a.sizes) * self.stride < 1 << 32 else "<u8"
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.groups: list[bytes] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)
        self.codes = np.zeros(0, dtype=self.kind)
        self.valid = np.zeros(0, dtype=bool)

    def add(self, units: list[bytes], whole: np.ndarray) -> None:
        a, n_a = self.a.encode(units, whole)
        b, n_b = self.b.encode([u.decode(errors="replace") for u in units])
        valid = _same_bytes(self.a, a, n_a, units) & _same_bytes(self.b, b, n_b, units)
        a, b = a[np.repeat(valid, n_a)], b[np.repeat(valid, n_b)]
        n_a, n_b = n_a * valid, n_b * valid
        # All new units end to end: each ends with a common end, so no group or link goes from one into another.
        a_ends, b_ends = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        cuts, a_group, b_group, link_a, link_b = align(a_ends, b_ends) if len(a) else (np.zeros(0, np.int64),) * 5
        unit_of_a = np.repeat(np.arange(len(units)), n_a)
        group_unit = unit_of_a[np.searchsorted(a_group, np.arange(len(cuts)))] if len(cuts) else np.zeros(0, np.int64)
        n_groups = np.bincount(group_unit, minlength=len(units))
        n_links = np.bincount(unit_of_a[link_a], minlength=len(units))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.codes = np.concatenate([self.codes, (a[link_a] * self.stride + b[link_b]).astype(self.kind)])
        self.valid = np.append(self.valid, valid)
        self.link_starts = np.cumsum(self.counts[:, 3]) - self.counts[:, 3]
        self.groups += self._texts(a, b, a_group, b_group, n_groups)

    def _texts(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_groups: np.ndarray) -> list[bytes]:
        """Each unit's groups as ``a1,a2|b1;a3|b2``."""
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        n = int(n_groups.sum())
        a_stops, b_stops = (np.searchsorted(g, np.arange(n), side="right").tolist() for g in (a_group, b_group))
        each = [
            ",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m])
            for i, j, k, m in zip([0, *a_stops], a_stops, [0, *b_stops], b_stops, strict=False)
        ]
        stops = np.cumsum(n_groups).tolist()
        return [";".join(each[i:j]).encode() for i, j in zip([0, *stops], stops, strict=False)]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_DOCS = "doc_id long, bundle long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def _small(x: np.ndarray) -> bytes:
    """Positive integers below 2**32; the bytes of each follow from their number and the length."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _tokenize(a_path: str, b_path: str):
    names = ["doc_id", "bundle", *_COUNTS, "groups_sha256", "codes", "times"]
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.binary() if n in ("codes", "times") else pa.int64()) for n in names])

    def run(batches):
        kept = worker_state("token_alignment")
        if (links := kept.get(("links", a_path, b_path))) is None:
            links = kept["links", a_path, b_path] = UnitLinks(a_path, b_path)
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = Texts(batch.column("text"))
            for lo, hi in texts.runs(RUN_BYTES):
                units = Units(texts, lo, hi, links.odd)
                number = links.numbers(units)
                docs, bounds = hi - lo, units.bounds
                good = np.bincount(units.owner[~links.valid[number]], minlength=docs) == 0
                if not good.all():
                    number, owner = number[good[units.owner]], units.owner[good[units.owner]]
                    bounds = np.searchsorted(owner, np.arange(docs + 1))
                else:
                    owner = units.owner
                counts = [np.bincount(owner, weights=c, minlength=docs).astype(np.int64) for c in links.counts[number].T]
                n_links = links.counts[number, 3]
                code = links.codes[ranges(links.link_starts[number], n_links)] if len(number) else np.zeros(0, np.int64)
                # Distinct pairs of each document and their links there.
                keys, times = np.unique(np.repeat(owner, n_links) << 40 | code.astype(np.int64), return_counts=True)
                stops = np.searchsorted(keys, np.arange(1, docs + 1) << 40).tolist()
                codes = (keys & (1 << 40) - 1).astype(links.kind)
                text = list(map(links.groups.__getitem__, number.tolist()))
                digests = [hashlib.sha256(b";".join(text[s:e])).hexdigest() if e > s else "" for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                sizes = np.cumsum(np.diff(texts.offsets[lo : hi + 1]))
                bundle = task * (1 << 32) + (seen + sizes) // GROUP_BYTES
                seen += int(sizes[-1])
                columns = [batch.column("doc_id").slice(lo, docs), pa.array(bundle), *map(pa.array, counts), pa.array(digests, pa.string())]
                columns += [pa.array([f(x[s:e]) for s, e in zip([0, *stops], stops, strict=False)], pa.binary()) for f, x in ((np.ndarray.tobytes, codes), (_small, times))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _pairs(kind: str):
    """The pairs of each bundle of documents: how many of these hold them."""
    schema = pa.schema([("bundle", pa.int64()), ("code", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        def counted(bundle, raw):
            codes, docs = np.unique(np.frombuffer(b"".join(raw), dtype=kind).astype(np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), bundle)), pa.array(codes), pa.array(docs)], schema=schema)

        bundle, held = None, []
        for batch in batches:
            for at, codes in zip(batch.column("bundle").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                if held and at != bundle:
                    yield counted(bundle, held)
                    held = []
                bundle = at
                held.append(codes)
        if held:
            yield counted(bundle, held)

    return run


def pair_counts(pairs: DataFrame, stride: int) -> DataFrame:
    """``code, docs, best`` of each pair: documents that hold it linked; whether no pair of its A id has more.

    Documents of a bundle are counted in the task; bundles' counts are summed in
    salted shares first, then those.
    """
    shares = pairs.groupBy("code", F.pmod("bundle", F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counts = staged(shares.groupBy("code").agg(F.sum("docs").alias("docs")), "pair-counts")
    a_id = F.floor(F.col("code") / stride).alias("a_id")
    most = counts.groupBy(a_id).agg(F.max("docs").alias("most"))
    return counts.select("*", a_id).join(most, "a_id").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _look_up(kind: str):
    def run(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
        code, count, best = (pairs.column(c).to_numpy() for c in ("code", "docs", "best"))
        order = np.argsort(code)
        code, count, best = code[order], count[order], best[order]
        n_best, count_sum = [], []
        for raw, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist(), strict=True):
            own = np.frombuffer(raw, dtype=kind).astype(np.int64)
            at, n = np.searchsorted(code, own), _large(times, len(own))
            n_best.append(int(n[best[at]].sum()) if len(own) else 0)
            count_sum.append(int((n * count[at]).sum()) if len(own) else 0)
        out = docs.select(["doc_id", *_COUNTS]).append_column("n_best", pa.array(n_best, pa.int64()))
        return out.append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))

    return run


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """How the tokens of two vocabularies lie on each text: one row per document.

    Both see a space before the text: A, byte-level, is given it; B, of pieces,
    adds it.  Byte offsets where tokens of both end cut them into groups; token
    pairs whose byte ranges overlap are linked.  Columns: ``doc_id``, ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``; ``n_best``, links whose id pair is held by
    no fewer documents than any pair of its A id; ``count_sum``, over links, the
    documents that hold the pair linked; ``groups_sha256`` of the groups' ids,
    ``a1,a2|b1;a3|b2``.

    Ends are cumulative sums of token bytes, common cuts their intersection,
    groups found by bisection and links by repetition, for all new units of a run
    at once (a unit, a word with the white space before it, ends with a common
    cut).  Distinct pairs are counted by bundles of documents, then in salted
    shares over all; each bundle then gets the counts of its own pairs.

    Strings of special tokens are plain text.  A null or empty text, and one whose
    joined tokens differ from it in bytes, has no tokens: zeros, and an empty
    ``groups_sha256``.  Rows repeated whole count as documents each; null ids are
    kept; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text = F.when(F.length("text") > 0, F.concat(F.lit(" "), F.col("text"))).cast("binary").alias("text")
    paths = (a_path or vocabulary_path("byte_bpe_50k.json"), b_path or vocabulary_path("piece_bpe_32k.model"))
    vocabularies = UnitLinks(*paths)
    aligned = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_tokenize(*paths), _DOCS), "aligned")
    linked = aligned.where("n_links > 0").select("bundle", "codes")
    pairs = staged(linked.mapInArrow(_pairs(vocabularies.kind), "bundle long, code long, docs long"), "pairs")
    known = pairs.select("bundle", "code").join(pair_counts(pairs, vocabularies.stride), "code")
    found = aligned.groupBy("bundle").cogroup(known.groupBy("bundle"))
    counts = ", ".join(f"{c} long" for c in ("doc_id", *_COUNTS, "n_best", "count_sum"))
    return found.applyInArrow(_look_up(vocabularies.kind), f"{counts}, groups_sha256 string")
