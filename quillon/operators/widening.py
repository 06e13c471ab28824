"""Tables whose columns differ: merged names, appended batches, known keys, and how full columns are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("cik", "accession", "context_id")


def merge_prefixes(df: DataFrame) -> DataFrame:
    """Columns that are equal behind their prefix (``us-gaap:Par``, ``Par``) become one, by the first that is known in column order."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.split(":", 1)[-1], []).append(c)
    quoted = {name: [F.col(f"`{c}`") for c in own] for name, own in groups.items()}
    return df.select(*[F.coalesce(*own).alias(name) for name, own in quoted.items()])


def append_batch(table: DataFrame | None, frames: list[DataFrame], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``table`` with the rows of ``frames``: its columns in their order, then new ones as they come; what a side lacks is null.

    Within the batch one row stays of those alike in the keys, compared as text;
    frames are by-name unions, so that rows with other columns are never rewritten.
    """
    if not frames:
        return table
    numbered = [f.select("*", F.lit(i).alias("_frame")) for i, f in enumerate(frames)]
    batch = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    own = [k for k in keys if k in batch.columns]
    if own:
        batch = batch.withColumns({k: F.col(k).cast("string") for k in own})
        columns = [F.col(f"`{c}`") for c in batch.columns if c not in own]
        first = F.min_by(F.struct(*columns), F.struct("_frame", F.xxhash64(*columns))).alias("_row")
        batch = batch.groupBy(*own).agg(first).select(*own, "_row.*")
    batch = batch.drop("_frame")
    if table is None:
        return batch
    table = table.withColumns({k: F.col(k).cast("string") for k in own if k in table.columns})
    return table.unionByName(batch, allowMissingColumns=True)


def not_parsed(filings: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("cik", "accession")) -> DataFrame:
    """Filings of which the table has no row; keys are compared as text."""
    known = table.select(*[F.col(k).cast("string").alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).cast("string") == F.col(f"_{k}") for k in keys]
    return filings.join(known, reduce(lambda a, b: a & b, same), "left_anti")


def fullness(df: DataFrame) -> DataFrame:
    """``column, non_null_count, percentage`` of every column but those of units."""
    columns = [c for c in df.columns if not c.endswith("-unitRef")]
    counts = df.agg(F.count("*").alias("_all"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null_count"), F.col("_all").alias("of")) for i, c in enumerate(columns)])
    share = F.coalesce(F.try_divide(F.col("non_null_count") * 100.0, F.col("of")), F.lit(0.0))
    return counts.select(F.inline(pairs)).select("column", "non_null_count", share.alias("percentage"))
