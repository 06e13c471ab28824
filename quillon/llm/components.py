"""Connected components of an edge table, by alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import drop, staged

#: Parts in which the edges of one node are looked up.
PARTS = 8


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; component is the least node.

    Large-star and small-star steps (each a partial aggregate and a join on the
    node) repeat until the edges are stars, round the least node of each
    component.  Every round is written to the shared folder.  Nulls and loops
    count as no edge; an empty table gives no rows.
    """
    now = staged(
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
    )
    while not _stars(now):
        after = staged(_small_star(_large_star(now)), "cc")
        drop(now)
        now = after
    least = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return least.unionByName(roots)


def _to_least(edges: DataFrame, key: str) -> DataFrame:
    """``edges`` with ``m``: the least node below ``key``, null if it has none.  A hub's rows are looked up in PARTS parts."""
    other = "u" if key == "v" else "v"
    lows = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    lows = lows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return edges.join(lows, (F.col(key) == F.col("x")) & (F.pmod(F.xxhash64(other), F.lit(PARTS)) == F.col("part")), "left")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least node beside it."""
    return _to_least(edges, "v").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    moved = _to_least(edges, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = edges.groupBy("u").agg(F.min("v").alias("v"))
    return moved.unionByName(own).where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether the edges are stars round roots: no node has two edges down, and no root has one."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    middle = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi")
    return twice.unionByName(middle).isEmpty()
