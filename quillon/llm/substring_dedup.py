"""Substring deduplication on the de Bruijn graph of word k-mers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_128_digest

from ._stage import drop, small_batches, staged
from ._words import Texts, Words, chunks, split_words, window_hashes


def _edges_of(words: Words, k: int, m: int):
    """Which words begin an edge (a k-word window within one text), and the anchor of each: the least hash of its m-word runs."""
    n = len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint64)
    runs = window_hashes(words.hashes, m)
    anchor = runs[:n].copy()
    for j in range(1, k - m + 1):
        np.minimum(anchor, runs[j : j + n], out=anchor)
    whole = words.left[:n] >= k
    return whole, anchor[whole]


def _anchors(k: int, m: int):
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = Texts(batch.column("text"))
            for a, b in texts.runs():
                words = texts.words(a, b)
                whole, anchor = _edges_of(words, k, m)
                if not len(anchor):
                    continue
                owner = words.owner[: len(whole)][whole]
                fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[fresh].view(np.int64)), pa.array(ids[a:b][owner[fresh]])], schema=schema
                )

    return run


def _edges(k: int, m: int):
    schema = pa.schema(
        [("edge", pa.int64()), ("check", pa.int16()), ("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("first", pa.bool_())]
    )

    def run(batches):
        for batch in batches:
            ids, version = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
            wanted = batch.column("anchors")
            texts = Texts(batch.column("text"))
            for a, b in texts.runs():
                words = texts.words(a, b)
                whole, anchor = _edges_of(words, k, m)
                if not len(anchor):
                    continue
                own = np.unique(wanted.slice(a, b - a).flatten().to_numpy(zero_copy_only=False))
                at = np.searchsorted(own, anchor.view(np.int64))
                hit = own[np.minimum(at, len(own) - 1)] == anchor.view(np.int64) if len(own) else np.zeros(len(anchor), bool)
                if not hit.any():
                    continue
                start = np.flatnonzero(whole)[hit]
                edge = window_hashes(words.hashes, k)[start]
                check = (window_hashes(words.hashes, k, base=1)[start] >> np.uint64(48)).astype(np.uint16)
                owner = words.owner[start] + a
                first = np.zeros(len(edge), dtype=bool)
                order = np.lexsort((start, edge, owner))
                first[order] = np.r_[True, (edge[order][1:] != edge[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(edge.view(np.int64)),
                        pa.array(check.view(np.int16)),
                        pa.array(ids[owner]),
                        pa.array(version[owner]),
                        pa.array(words.place[start].astype(np.int32)),
                        pa.array(first),
                    ],
                    schema=schema,
                )

    return run


#: Spans of this many words or more are compared with their source.
LONG_WORDS = 50
#: They are compared in blocks of so many words, so that a difference counts for the windows about it alone.
BLOCK_WORDS = 64


def _blocks(words: list[bytes]) -> list[bytes]:
    return [xxh3_128_digest(b" ".join(words[i : i + BLOCK_WORDS])) for i in range(0, len(words), BLOCK_WORDS)]


_ASKED = "source_doc long, source_version long, source_start int, n_words int, digests array<binary>"


def _digests(batches):
    """The digests of the asked-for spans of a text, in one pass over it."""
    schema = pa.schema(
        [("source_doc", pa.int64()), ("source_version", pa.int64()), ("source_start", pa.int32()), ("n_words", pa.int32()), ("digests", pa.list_(pa.binary()))]
    )
    for batch in batches:
        for doc, version, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "asked")), strict=True):
            words, starts, sizes = split_words(text), [x["source_start"] for x in asked], [x["n_words"] for x in asked]
            found = [_blocks(words[i : i + n]) for i, n in zip(starts, sizes, strict=True)]
            columns = ([doc] * len(asked), [version] * len(asked), starts, sizes, found)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _confirmed(cut: dict, words: list[bytes], k: int) -> list[dict]:
    """The parts of a span that are as at its source: all of it, or the runs of blocks that agree, if a window fits in."""
    start, end, want = cut["start"], cut["end"], cut["digests"]
    plain = {c: cut[c] for c in ("source_doc", "source_start")}
    if want is None or (own := _blocks(words[start:end])) == want:
        return [plain | {"start": start, "end": end}]
    out, at = [], None
    for i, same in enumerate([*(x == y for x, y in zip(own, want, strict=False)), False]):
        if same and at is None:
            at = start + i * BLOCK_WORDS
        elif not same and at is not None:
            stop = min(end, start + i * BLOCK_WORDS)
            if stop - at >= k:
                out.append({"source_doc": cut["source_doc"], "source_start": cut["source_start"] + at - start, "start": at, "end": stop})
            at = None
    return out


def _keep(k: int):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_doc", pa.int64()), ("source_start", pa.int32())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(span))]
    )

    def run(batches):
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans")
            for a, b in chunks(texts):
                total, removed, kept, cuts = [], [], [], []
                for text, cut in zip(texts[a:b], spans.slice(a, b - a).to_pylist(), strict=True):
                    words = split_words(text)
                    total.append(len(words))
                    cut = [part for c in cut or () for part in _confirmed(c, words, k)]
                    if cut:
                        edges = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edges, [c["start"] for c in cut], 1)
                        np.subtract.at(edges, [c["end"] for c in cut], 1)
                        stay = np.cumsum(edges[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                    cuts.append(sorted(cut, key=lambda c: (c["start"], c["end"])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(total, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array(cuts, pa.list_(span)),
                    ],
                    schema=schema,
                )

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, version, text``; versions, 64-bit hashes of the texts, tell rows of one doc_id apart and are 0 where it stands once."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counts = plain.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    several = staged(counts.where("rows > 1").select("doc_id", F.lit(True).alias("several")), "several")
    version = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0))
    return plain.join(several, "doc_id", "left").select("doc_id", version.alias("version"), "text")


def repeated_edges(docs: DataFrame, k: int = 13, anchor_words: int = 6) -> DataFrame:
    """Every place of a k-word window that also stands in a document of smaller doc_id.

    Rows ``(doc_id, version, pos, source_doc, source_version, source_pos)``:
    ``pos`` is the window's first word, ``source_doc`` the least document that
    holds it and ``source_pos`` its first place in the text ``source_version``
    there.  Versions tell apart different texts under one doc_id.

    A k-mer is an edge of the de Bruijn graph, and its source coordinates name
    it.  First each window is reduced to its anchor, the least hash of its runs
    of ``anchor_words``, which neighbouring windows share; only windows whose
    anchor occurs in two documents are hashed in full (64 bits, and 16 more of
    another polynomial) and counted.  Null doc_ids take no part.
    """
    small_batches(docs.sparkSession)
    plain = _rows(docs).where("doc_id is not null")
    anchors = plain.select("doc_id", "text").mapInArrow(_anchors(k, anchor_words), "anchor long, doc_id long")
    common = (
        anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    )
    wanted = staged(anchors.join(common, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    places = staged(
        plain.join(wanted, "doc_id").mapInArrow(
            _edges(k, anchor_words), "edge long, check smallint, doc_id long, version long, pos int, first boolean"
        ),
        "edges",
    )
    drop(wanted)
    edges = (
        places.where("first")
        .groupBy("edge", "check")
        .agg(
            F.min("doc_id").alias("source_doc"),
            F.max("doc_id").alias("hi"),
            *[F.min_by(c, "doc_id").alias(f"source_{c}") for c in ("version", "pos")],  # of the same row: both are kept by the same comparisons
        )
        .where("source_doc < hi")
        .drop("hi")
    )
    edges = staged(edges, "sources")
    found = places.drop("first").join(edges, ["edge", "check"]).where("source_doc < doc_id").drop("edge", "check")
    found._quillon_uses = (places, edges)
    return found


_SOURCE = ["source_doc", "source_version"]


def _segments(edges: DataFrame) -> DataFrame:
    """Runs of windows that follow each other both in a text and in one source text: ``(doc_id, version, start, n, source_doc, source_version, source_start)``, in windows."""
    lines = edges.groupBy("doc_id", "version", *_SOURCE, (F.col("source_pos") - F.col("pos")).alias("shift")).agg(
        F.sort_array(F.collect_set("pos")).alias("at")
    )
    heads = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) < p - 1))
    tails = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + 1), p + 2) > p + 1)
    runs = lines.select("doc_id", "version", *_SOURCE, "shift", F.explode(F.arrays_zip(heads.alias("head"), tails.alias("tail"))).alias("s"))
    return runs.select(
        "doc_id",
        "version",
        F.col("s.head").alias("start"),
        (F.col("s.tail") - F.col("s.head") + 1).alias("n"),
        *_SOURCE,
        (F.col("s.head") + F.col("shift")).alias("source_start"),
    )


def repeated_paths(docs: DataFrame, k: int = 13, anchor_words: int = 6) -> DataFrame:
    """Repeated passages, compacted to nonbranching paths, at each place but those in their source.

    Rows ``(doc_id, version, start, n_words, source_doc, source_version, source_start)``: the
    words of a text from ``start`` on are those of the source from ``source_start`` on.

    Repeated edges with successive source coordinates are joined to segments.
    Where one segment of a text ends and the next begins, the text goes on from
    one edge of the graph to another edge than the source does: joined on these
    ends, segments give the branches, after the last edge of the one and before
    the first of the other.  All segments over such a place are cut there, so
    every path is read from end to end alike by all texts that go on along it.
    """
    edges = repeated_edges(docs, k, anchor_words)
    segments = staged(_segments(edges), "segments")
    drop(*edges._quillon_uses)
    text = ["doc_id", "version"]
    place = [F.col(a).alias(b) for a, b in zip(_SOURCE, "dv", strict=True)]
    ends = segments.select(*text, (F.col("start") + F.col("n")).alias("at"), *place, (F.col("source_start") + F.col("n")).alias("p"))
    begins = segments.select(*text, F.col("start").alias("at"), *_SOURCE, "source_start")
    meet = ends.join(begins, [*text, "at"])
    branches = meet.select("d", "v", "p").unionByName(meet.select(*place, F.col("source_start").alias("p"))).distinct()
    cuts = branches.groupBy("d", "v").agg(F.sort_array(F.collect_list("p")).alias("cuts"))  # at most one for each word of the source
    stretch = [*_SOURCE, "source_start", "n"]
    last = F.col("source_start") + F.col("n")
    pieces = (
        segments.select(*stretch)
        .distinct()
        .join(cuts.withColumnsRenamed(dict(zip("dv", _SOURCE, strict=True))), _SOURCE, "left")
        .withColumn("inside", F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > F.col("source_start")) & (c < last)))
        .select(*stretch, F.arrays_zip(F.concat(F.array("source_start"), "inside").alias("a"), F.concat("inside", F.array(last)).alias("b")).alias("pieces"))
    )
    pieces = staged(pieces, "pieces")
    paths = segments.join(pieces, stretch).select(*text, "start", "source_start", *_SOURCE, F.explode("pieces").alias("s"))
    out = paths.select(
        *text,
        (F.col("start") + F.col("s.a") - F.col("source_start")).alias("start"),
        (F.col("s.b") - F.col("s.a") + k - 1).alias("n_words"),
        *_SOURCE,
        F.col("s.a").alias("source_start"),
    )
    out._quillon_uses = (segments, pieces)
    return out


def substring_dedup(docs: DataFrame, k: int = 13, anchor_words: int = 6) -> DataFrame:
    """Remove every word covered by a k-word window that also starts in a document of smaller doc_id.

    One row per input row: ``doc_id, n_words, n_removed, kept_text`` (the words
    left, joined by one space) and ``spans`` (start, end, source_doc,
    source_start, in words: the repeated paths).  Windows are judged on the
    input.  Spans of LONG_WORDS or more count where their words, as 128-bit
    digests of blocks, are those at their source coordinates; windows that touch
    a block which differs do not.

    Null and empty texts: no words, nothing removed.  A null doc_id is kept
    whole and is no one's source.  Rows of equal doc_id are no source for each
    other, so rows repeated whole keep their words; of different texts under the
    doc_id of a source, each span names and is compared with the one it is in.
    Texts under ``k`` words are kept.  Other columns are ignored; an empty table gives no rows.
    """
    paths = staged(found := repeated_paths(docs, k, anchor_words), "paths")
    drop(*found._quillon_uses)
    place = [*_SOURCE, "source_start", "n_words"]
    asked = paths.where(F.col("n_words") >= LONG_WORDS).select(*place).distinct()
    asked = asked.groupBy(F.col("source_doc").alias("doc_id"), F.col("source_version").alias("version")).agg(
        F.collect_list(F.struct("source_start", "n_words")).alias("asked")  # a path is cut where another begins: few for each word
    )
    plain = _rows(docs)
    sources = plain.join(asked, ["doc_id", "version"]).mapInArrow(_digests, _ASKED).dropDuplicates(place)
    spans = staged(
        paths.join(staged(sources, "digests"), place, "left")
        .groupBy("doc_id", "version")
        .agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n_words")).alias("end"), "source_doc", "source_start", "digests")).alias("spans")),
        "spans",
    )
    drop(paths)
    return (
        plain.join(spans, ["doc_id", "version"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_keep(k), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int,source_doc:bigint,source_start:int>>")
    )
