"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import small_batches, staged

#: Documents of one source whose order is settled in one window group, on average.
GROUP_DOCS = 2_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame, source: str = "source") -> DataFrame:
    """``sizes`` with ``rank``, from 0, by code point order of the source, null last.

    Two passes: rows are dealt by range and counted by partition, then numbered within it.
    """
    dealt = staged(
        sizes.withColumn("_null", F.col(source).isNull())
        .repartitionByRange("_null", source)
        .withColumn("_part", F.spark_partition_id()),
        "sources",
    )
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy("_null", source)
    return (
        dealt.join(bases, "_part")
        .withColumn("rank", F.row_number().over(within) - 1 + F.col("_base"))
        .drop("_part", "_base", "_null")
    )


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (with ``weight`` and ``source_size``) with ``target``: shares of ``total`` by weight, none above ``max_epochs`` times its size.

    Sources whose share is above their cap are clamped and the rest of the
    total is shared again by weight, until none is above.  A round sends three
    sums to the driver; clamped sources are those below the last level.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        below = cap < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(below, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(below, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.sum(below.cast("long")).alias("clamped"),
        ).first()
        if row.clamped is None or row.clamped == clamped:
            break
        clamped = row.clamped
        if not row.free:
            break
        level = max(level, (total - row.held) / row.free)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    epochs: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 1,
    source: str = "source",
    size: str = "size",
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies``: how often the mix takes each document.

    Sources in code point order, null last, have the repeating ``weights`` and
    share ``epochs`` times all sizes; a source stops at ``max_epochs`` times its
    own size and the excess is shared again by weight.  A source's rate is
    target / source_size: its whole part is taken of every document, and its
    fractional part from documents in seeded order until the words taken come
    nearest to the target, so a source misses its target by at most half of one
    document.  No document is taken more than ``max_epochs`` (rounded up) times.

    The order within a source is dealt to groups by the seeded hash, summed by
    group first, so a large source is not one window.  The draw depends on
    (seed, doc_id, size) alone; rows equal in these are ordered by their other
    columns' hash, rows without an id are drawn by it, and reruns agree.  Documents of size 0 are taken at the whole
    part.  A null or negative size counts as 0.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own.values()).withColumns(
        {"source": F.col(own[source]), "size": F.greatest(F.coalesce(F.col(own[size]).cast("long"), F.lit(0)), F.lit(0))}
    )
    rows = staged(rows, "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = staged(ranked_sources(sizes), "ranked")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    filled = staged(water_fill(ranked.withColumn("weight", weight), epochs * total, max_epochs), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = filled.select(
        F.col("source").alias("s"),
        F.col("source_size"),
        F.col("target"),
        F.floor(rate).alias("whole"),
        ((rate - F.floor(rate)) * F.col("source_size")).alias("extra"),
        F.ceil(F.col("n_docs") / GROUP_DOCS).cast("long").alias("groups"),
    )
    others = [F.col(c) for c, t in zip(own.values(), docs.schema, strict=True) if "map" not in t.dataType.simpleString()]
    draw = F.xxhash64(F.lit(seed), *([F.col(own["doc_id"])] if "doc_id" in own else []), "size")
    if "doc_id" in own:  # rows without an id are dealt by all they hold
        draw = F.when(F.col(own["doc_id"]).isNull(), F.xxhash64(F.lit(seed), "tie")).otherwise(draw)
    dealt = (
        rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("tie", F.xxhash64(*others))
        .withColumn("draw", F.shiftrightunsigned(draw, 1))
        .withColumn("group", F.floor(F.col("draw") / (F.lit(float(2**63)) / F.col("groups"))))
    )
    group_sizes = dealt.groupBy(F.col("s").alias("gs"), F.col("group").alias("g")).agg(F.sum("size").alias("group_size"))
    ahead = Window.partitionBy("gs").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(
        group_sizes.select("gs", "g", F.coalesce(F.sum("group_size").over(ahead), F.lit(0)).alias("group_start")), "groups"
    )
    within = Window.partitionBy("s", "group").orderBy("draw", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("in_group", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        starts, F.col("s").eqNullSafe(F.col("gs")) & (F.col("group") == F.col("g"))
    )
    middle = F.col("group_start") + F.col("in_group") + F.col("size") / 2
    extra = ((middle < F.col("extra")) & (F.col("size") > 0)).cast("long")
    return placed.select(
        *[F.col(i).alias(c) for c, i in own.items()],
        F.col("source_size").alias("source_size"),
        F.col("target").alias("target"),
        (F.col("whole") + extra).cast("long").alias("copies"),
    )


def repeat_documents(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """Each row as often as ``copies`` says, reduced to ``columns``."""
    return mixed.where(F.col(copies) > 0).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns)
