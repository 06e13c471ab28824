"""Conversation prefix trie: chained digests of every prefix, nodes by digest, subtree sums over ancestors."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import drop, small_batches, staged

#: A node's members are counted, and looked up, in this many shares.
SALTS = 16
#: Members' ids are joined to pieces of at most this many before a node's digest is taken over its pieces.
PIECE_IDS = 4096
_DIGEST_BYTES = 16


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, n_chars`` of each turn: 128 bits of a SHA-256 of role and text, and the text's code points.

    Null roles and texts count as empty; turns of a null conv_id are of no conversation and go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * _DIGEST_BYTES)).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"),
    )


def numbered(digests: DataFrame) -> DataFrame:
    """``turn`` becomes the turn's number from 1: by turn (null first), then by digest."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return digests.withColumn("turn", F.row_number().over(order).cast("long"))


def _chain():
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("prefix", pa.binary()), ("n_chars", pa.int64()), ("last", pa.bool_())])

    def run(batches):
        conv, depth, prefix, held = None, 0, b"", None
        for batch in batches:
            rows: list[tuple] = []
            for c, digest, n in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "digest", "n_chars")), strict=True):
                if held is not None:
                    rows.append((*held, c != conv))
                if c != conv:
                    conv, depth, prefix = c, 0, b""
                else:
                    depth, prefix = depth + 1, hashlib.sha256(prefix + digest).digest()[:_DIGEST_BYTES]
                held = (conv, depth, prefix, n)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held, True), schema, strict=True)], schema=schema)

    return run


def _prefixes(digests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one first: ``conv_id, depth, prefix, n_chars, last``.

    A task reads its conversations turn by turn in order and keeps one digest;
    no conversation is held whole.
    """
    roots = conversations.select("conv_id", F.lit(0).alias("is_turn"), F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    rows = roots.unionByName(digests.select("conv_id", F.lit(1).alias("is_turn"), "turn", "digest", "n_chars"))
    order = ["conv_id", "is_turn", F.col("turn").asc_nulls_first(), "digest"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_chain(), "conv_id long, depth int, prefix binary, n_chars long, last boolean")


def _owned(prefixes: DataFrame) -> DataFrame:
    """Prefixes with their node's smallest member, ``owner``, and number of members, ``n_convs``.

    Shares of a node's members, dealt by conv_id, are counted first and their
    counts summed; each share of the prefixes then looks up its own copy, so that
    a node of a third of all conversations is ``SALTS`` keys.
    """
    node = ["depth", "prefix"]
    salted = prefixes.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    shares = salted.groupBy(*node, "salt").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"))
    totals = shares.groupBy(*node).agg(F.min("owner").alias("owner"), F.sum("n").alias("n_convs")).where("n_convs > 1")
    shared = shares.select(*node, "salt").join(totals, node)
    found = salted.join(shared, [*node, "salt"], "left")
    return found.select(
        "conv_id", "depth", "n_chars", "last", F.coalesce("owner", "conv_id").alias("owner"), F.coalesce("n_convs", F.lit(1)).alias("n_convs")
    )


def _join_ids():
    """Consecutive ids of a node as comma-joined text, with the first of them."""
    schema = pa.schema([("owner", pa.int64()), ("depth", pa.int32()), ("first", pa.int64()), ("ids", pa.string())])

    def run(batches):
        node, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, ids[0], ",".join(map(str, ids))), schema, strict=True)], schema=schema)

        for batch in batches:
            for owner, depth, conv in zip(*(batch.column(k).to_pylist() for k in ("owner", "depth", "conv_id")), strict=True):
                if ids and ((owner, depth) != node or len(ids) >= PIECE_IDS):
                    yield piece()
                    ids = []
                node = (owner, depth)
                ids.append(conv)
        if ids:
            yield piece()

    return run


def _digest_ids():
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("ends_sha256", pa.string())])

    def run(batches):
        node = digest = None
        for batch in batches:
            done: list[tuple] = []
            for owner, depth, ids in zip(*(batch.column(k).to_pylist() for k in ("owner", "depth", "ids")), strict=True):
                if (owner, depth) == node:
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (owner, depth), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*node, digest.hexdigest()), schema, strict=True)], schema=schema)

    return run


def _ends(owned: DataFrame) -> DataFrame:
    """SHA-256 of each node's ending members' ids: sorted by ranges, joined to pieces there, and the pieces hashed in order."""
    order = ["owner", "depth", "conv_id"]
    sorted_ids = owned.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = sorted_ids.mapInArrow(_join_ids(), "owner long, depth int, first long, ids string")
    dealt = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first")
    return dealt.mapInArrow(_digest_ids(), "conv_id long, depth int, ends_sha256 string")


def digest_trie(digests: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``prefix_trie`` of turns known by their digests (``conv_id, turn, digest, n_chars``; ids not null)."""
    spark = digests.sparkSession
    small_batches(spark)
    ids = digests.select("conv_id")
    if conversations is not None:
        ids = ids.unionByName(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")))
    prefixes = staged(_prefixes(digests, ids.distinct()), "prefixes")
    owned = staged(_owned(prefixes), "owned")
    drop(prefixes)

    # Nodes with one smallest member are a chain: the end of that member's path.  A node is known by (conv_id, depth).
    nodes = owned.where("owner = conv_id").select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("chain_saved"))
    # The chains above: where each is left, and the one just above.
    above = owned.where("owner != conv_id").groupBy("conv_id", "owner").agg(F.max("depth").alias("left_at"))
    above = staged(above.join(chains, "conv_id").withColumn("child", (F.col("left_at") == F.col("top") - 1).cast("long")), "above")
    forks = above.where("child = 1").groupBy(F.col("owner").alias("conv_id"), F.col("left_at").alias("depth")).agg(F.count("*").alias("forks"))
    childless = chains.join(forks.withColumnRenamed("depth", "bottom"), ["conv_id", "bottom"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))

    # Each chain's sums go to all chains above it, at the node where its path leaves them.
    sums = above.join(childless, "conv_id", "left").groupBy(F.col("owner").alias("conv_id"), F.col("left_at").alias("depth"))
    received = sums.agg(F.sum("chain_saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"), F.sum("child").alias("forks"))
    parents = above.where("child = 1").select("conv_id", F.col("top").alias("depth"), F.col("owner").alias("parent"))
    here = (
        nodes.join(chains.select("conv_id", "top", "bottom"), "conv_id")
        .join(received, ["conv_id", "depth"], "left")
        .join(parents, ["conv_id", "depth"], "left")
        .join(_ends(owned), ["conv_id", "depth"], "left")
    )
    goes_on = (F.col("depth") < F.col("bottom")).cast("long")
    n_children = F.coalesce("forks", F.lit(0)) + goes_on
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return here.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        n_children.alias("n_children"),
        F.sum(F.coalesce("more_leaves", F.lit(0)) + (n_children == 0).cast("long")).over(below).alias("n_leaves"),
        F.sum(F.col("saved") + F.coalesce("more_saved", F.lit(0))).over(below).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The trie of conversations (``conv_id, turn, role, text``) that begin alike, one row per node.

    A node is a distinct sequence of first turns, by role and text; its members
    are the conversations that begin with it.  The root is the empty sequence.
    Columns, of long: ``conv_id``, the smallest member, which with ``depth`` names
    the node; ``parent_conv_id`` (null for the root); ``n_convs``, members;
    ``n_children``; ``n_leaves``, childless nodes of the subtree, itself included;
    ``saved_tokens``, over the subtree, code points of a node's last text times
    its members but one; and ``ends_sha256`` (string), a digest of the ids of the
    members that end there, ascending and joined by commas.

    Turns are ordered by ``turn``, null first, then by digest.  Each
    conversation's prefixes have chained digests; every prefix is exploded, and
    grouped by (depth, digest) in salted shares.  Sums over subtrees go from each
    node to all its ancestors, where nodes that have one smallest member, a chain,
    are summed before and go as one; within a chain a window runs up from its end.
    So no more rows are made than there are prefixes.

    Null roles and texts count as empty, repeated turns each count; turns of a
    null conv_id are of no conversation; other columns are ignored.
    ``conversations`` names further ones, by conv_id, that may lack turns and end
    at the root.  Without any conversation there is no node.
    """
    return digest_trie(turn_digests(turns), conversations)


def shared_starts(digests: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt to begin alike: the first h turns of conversation ``c - c % block``, then c's own after its first h.

    h is the CRC-32 of c in decimal, modulo ``most``; ``turn`` becomes the number in the conversation it comes from.
    """
    turns = numbered(digests)
    cut = F.crc32(F.col("conv_id").cast("string")) % most
    own = turns.where(F.col("turn") > cut)
    givers = turns.where((F.col("conv_id") % block == 0) & (F.col("turn") < most)).withColumnRenamed("conv_id", "giver")
    takers = digests.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("giver"), cut.alias("cut"))
    given = takers.join(givers, "giver").where("turn <= cut").select(*own.columns)
    return own.unionByName(given)
