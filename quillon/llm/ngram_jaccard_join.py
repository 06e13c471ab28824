"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, verification on full n-gram sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ._stage import drop, small_batches, staged, worker_state
from ._words import Texts, Words, window_hashes
from .components import connected_components

#: Members of a block, and n-grams in their sets, about, when pairs are dealt to tasks: what a task holds of two blocks.
BLOCK, BLOCK_GRAMS = 2048, 1 << 20
#: Parts in which the members of one group are looked up.
SALTS = 16


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` values each so that a pair at ``threshold`` meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """The set of n-gram hashes of each text, sorted; a text of fewer than n words is one shorter n-gram."""
    grams = window_hashes(words.hashes, n)
    ends = np.cumsum(words.counts)
    out = []
    for begin, end in zip((ends - words.counts).tolist(), ends.tolist(), strict=True):
        if end - begin >= n:
            out.append(np.unique(grams[begin : end - n + 1]))
        elif end > begin:
            out.append(window_hashes(words.hashes[begin:end], end - begin))
        else:
            out.append(words.hashes[:0])
    return out


def _band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int) -> np.ndarray:
    """(text, band) -> hash of ``rows`` MinHash values; all sets are non-empty."""
    flat = np.concatenate(sets).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    work = np.empty_like(flat)
    prime = np.uint64(0x100000001B3 * 0x10001 | 1)
    for i in range(bands * rows):
        np.multiply(flat, mult[i], out=work)
        np.add(work, add[i], out=work)
        least = np.minimum.reduceat(work, starts)
        band = i // rows
        out[:, band] = (out[:, band] ^ least) * prime
        out[:, band] ^= out[:, band] >> np.uint64(29)
    out += np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _signatures(n: int, bands: int, rows: int, seed: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches):
        worker_state("ngram_jaccard_join")
        for batch in batches:
            ids, texts = batch.column("doc_id"), Texts(batch.column("text"))
            for a, b in texts.runs():
                sets = shingle_sets(texts.words(a, b), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                band = {}
                if full:
                    found = _band_hashes([sets[i] for i in full], bands, rows, seed).view(np.int64)
                    band = dict(zip(full, found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([band.get(i) for i in range(b - a)], pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return run


def _sets(n: int):
    """The digest and the n-gram set of each text; other columns pass through."""

    def run(batches):
        worker_state("ngram_jaccard_join")
        for batch in batches:
            texts = Texts(batch.column("text"))
            carried = [c for c in batch.schema.names if c != "text"]
            for a, b in texts.runs():
                sets = [s.view(np.int64) for s in shingle_sets(texts.words(a, b), n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in carried]
                    + [pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                    names=[*carried, "met", "grams"],
                )

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(left) * len(right) <= 36:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    every = left if same else left + right
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.r_[True, flat[1:] != flat[:-1]]
    gram = np.cumsum(fresh) - 1
    shared = np.bincount(gram)[gram] > 1
    gram, owner = gram[shared], owner[shared]
    total = np.zeros((len(left), len(right)), dtype=np.float64)
    if len(gram):
        gram = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
        wide = max(256, min(4096, (1 << 22) // len(every)))
        for low in range(0, int(gram[-1]) + 1, wide):
            a, b = np.searchsorted(gram, [low, low + wide])
            block = np.zeros((len(every), wide), dtype=np.float32)
            block[owner[a:b], gram[a:b] - low] = 1
            total += block[: len(left)] @ (block if same else block[len(left) :]).T
    return total


def _block_links(threshold: float):
    """For each (block, block): how many documents each class links to, and edges that span the links."""
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def solve(rows: list[tuple]) -> list[tuple[int, int, int | None]]:
        i, j = rows[0][0], rows[0][1]
        left = [r for r in rows if r[2] == i]
        right = left if i == j else [r for r in rows if r[2] == j]
        if not left or not right or len(rows) < 2:
            return []
        sets = [[np.asarray(r[5]) for r in side] for side in (left, right)]
        inter = _overlaps(sets[0], sets[0] if i == j else sets[1], i == j)
        na, nb = (np.array([len(s) for s in side], dtype=np.float64) for side in sets)
        linked = inter / (na[:, None] + nb[None, :] - inter) >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        out = []
        copies_a, copies_b = (np.array([r[4] for r in side]) for side in (left, right))
        for side, counts in ((left, linked @ copies_b), (right, copies_a @ linked))[: 1 + (i != j)]:
            out += [(r[3], int(c), None) for r, c in zip(side, counts, strict=True) if c]
        parent = {r[3]: r[3] for r in rows}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(*np.nonzero(linked), strict=True):
            p, q = root(left[x][3]), root(right[y][3])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((max(p, q), 0, min(p, q)))
        return out

    def run(batches):
        worker_state("ngram_jaccard_join")
        held: list[tuple] = []

        def flush(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "block", "cls", "copies", "grams")]
            found = []
            for row in zip(*cols, strict=True):
                if held and row[:2] != held[0][:2]:
                    found += solve(held)
                    held = []
                if not held or row[2:4] != held[-1][2:4]:  # a repeated row stands once
                    held.append(row)
            if found:
                yield flush(found)
        if held and (found := solve(held)):
            yield flush(found)

    return run


def _blocks(classes: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(cls, block)`` of every class that shares a band, and the pairs of blocks ``(i, j)`` whose members share one.

    A class is at home in its fullest band bucket, and follows the fullest home
    among all classes that it shares a bucket with, so most of a family follows
    one.  Followers are split by hash into blocks of about BLOCK members or
    BLOCK_GRAMS n-grams; only blocks that meet in some bucket are compared.
    """
    entries = classes.select("cls", F.explode("bands").alias("band"))
    counts = entries.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    shared = staged(entries.join(counts, "band"), "shared")
    home = shared.groupBy("cls").agg(F.max(F.struct("m", "band")).alias("home"))
    top = shared.select("cls", "band").join(home, "cls").groupBy("band").agg(F.max("home").alias("top"))
    leads = shared.select("cls", "band").join(top, "band").groupBy("cls").agg(F.max("top").alias("lead"))
    leads = staged(leads.select("cls", F.col("lead.band").alias("lead")).join(classes.select("cls", "n_shingles"), "cls"), "leads")
    sizes = leads.groupBy("lead").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("grams"))
    parts = F.ceil(F.greatest(F.col("m") / F.lit(BLOCK), F.col("grams") / F.lit(BLOCK_GRAMS))).cast("long")
    # A large group is looked up in SALTS parts.
    sizes = sizes.select("lead", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = leads.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(sizes, ["lead", "salt"])
    part = F.pmod(F.xxhash64("cls", F.lit(seed)), F.col("parts"))
    blocks = staged(dealt.select("cls", F.xxhash64("lead", part).alias("block")), "blocks")
    stands = staged(shared.join(blocks, "cls").select("band", "block").distinct(), "stands")
    pairs = (
        stands.join(stands.withColumnRenamed("block", "other"), "band")
        .where("block <= other")
        .select(F.col("block").alias("i"), F.col("other").alias("j"))
        .distinct()
    )
    pairs = staged(pairs, "pairs")
    drop(shared, leads, stands)
    return blocks, pairs


def ngram_jaccard_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 8, seed: int = 1
) -> DataFrame:
    """Near-duplicate documents: Jaccard similarity of word n-gram sets of at least ``threshold``.

    One row per input row: ``doc_id, n_shingles, copy_of`` (least doc_id with
    the same n-gram set), ``class_id`` (least doc_id of the connected group of
    linked documents), ``n_links`` (other documents at or above the threshold,
    copies counted one by one), ``digest`` (of the n-gram set, 128 bits, null
    without n-grams) and ``group_key`` (the same for all rows of a group).

    Documents with equal n-gram sets are one class before banding, so copies
    never meet as pairs.  Classes are dealt to blocks by their fullest band
    bucket; two blocks are compared, on full n-gram sets, only if members of
    both share a band hash, each pair of classes in one task.  Tasks return link
    counts and spanning edges, not pairs.  ``recall`` is the chance that a pair
    exactly at the threshold shares a band.

    Null or empty texts have no n-grams and no links: ``copy_of`` and
    ``class_id`` are their own doc_id.  A text of fewer than ``n`` words has one
    n-gram, all its words.  Rows repeated whole count as copies.  A row without
    doc_id takes part like any other; a class or group of such rows alone has a
    null ``copy_of`` or ``class_id``.  Other columns are ignored.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bands = choose_bands(threshold, recall, rows)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sig = staged(
        plain.mapInArrow(_signatures(n, bands, rows, seed), "doc_id long, n_shingles long, digest binary, bands array<bigint>"),
        "sig",
    )
    classes = staged(
        sig.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("copy_of"),
            F.count("*").alias("copies"),
            F.min("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),  # equal sets have equal bands
        )
        .select(F.monotonically_increasing_id().alias("cls"), "*"),
        "classes",
    )
    blocks, pairs = _blocks(classes, seed)
    wanted = blocks.join(classes.select("cls", "digest", "copy_of", "copies"), "cls")
    columns = ["cls", "block", "copies", "digest", "text"]
    named = wanted.where("copy_of is not null").join(plain, F.col("copy_of") == F.col("doc_id")).select(*columns)
    sets = named.mapInArrow(_sets(n), "cls long, block long, copies long, digest binary, met binary, grams array<bigint>").where("met = digest")
    # Rows without an id are found by their digest.
    nameless = plain.where("doc_id is null and text is not null").mapInArrow(_sets(n), "doc_id long, met binary, grams array<bigint>")
    first = nameless.groupBy("met").agg(F.first("grams").alias("grams"))
    sets = sets.select("cls", "block", "copies", "grams").unionByName(
        wanted.where("copy_of is null").join(first, F.col("digest") == F.col("met")).select("cls", "block", "copies", "grams")
    )
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    links = staged(
        sets.join(sides, "block")
        .select("i", "j", "block", "cls", "copies", "grams")
        .repartition("i", "j")
        .sortWithinPartitions("i", "j", "block", "cls")
        .mapInArrow(_block_links(threshold), "cls long, links long, other long"),
        "links",
    )
    joined = connected_components(links.where("other is not null"), "cls", "other")
    heads = staged(
        classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left")
        .join(links.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left")
        .select("cls", "digest", "copy_of", "copies", F.coalesce("component", "cls").alias("component"), F.coalesce("links", F.lit(0)).alias("links")),
        "heads",
    )
    # Groups of one class name themselves; a large group is looked up in SALTS parts.
    several = heads.where("component <> cls").select("component").distinct()
    salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS))
    roots = (
        heads.join(several, "component", "left_semi")
        .groupBy("component")
        .agg(F.min("copy_of").alias("class_id"))
        .select(F.col("component").alias("root"), "class_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    groups = (
        heads.withColumn("part", salt).join(roots, (F.col("component") == F.col("root")) & (F.col("part") == F.col("salt")), "left")
        .select("digest", "copy_of", "copies", F.when(F.col("root").isNull(), F.col("copy_of")).otherwise(F.col("class_id")).alias("class_id"), "links", F.col("component").alias("group_key"))
    )
    groups = staged(groups, "groups")
    drop(blocks, pairs, links, classes, heads)
    return sig.join(groups, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        "digest",
        "group_key",
    )


def with_digest(docs: DataFrame, n: int = 5, name: str = "digest") -> DataFrame:
    """``docs`` with the 128-bit digest of each text's n-gram set as ``name``, as in ``ngram_jaccard_join``; null without n-grams."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    fields = [f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.schema, strict=True)]

    def run(batches):
        worker_state("ngram_jaccard_join")
        for batch in batches:
            texts = Texts(batch.column("_text"))
            for a, b in texts.runs():
                sets = shingle_sets(texts.words(a, b), n)
                digests = pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in inner), digests], names=[*inner, "_digest"])

    text = F.col(inner[docs.columns.index("text")]).cast("binary").alias("_text")
    out = docs.toDF(*inner).select(*inner, text).mapInArrow(run, ", ".join([*fields, "_digest binary"]))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)], F.col("_digest").alias(name))
