"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import drop, small_batches, staged

#: Index rows and queries that one task compares at a time for one bucket.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Queries whose best candidates a task holds before it passes them on, and index rows that it compares in one go.
HELD_QUERIES, HELD_ROWS = 20_000, 32_768
#: Numbers of hashes and widths, in distances of the k-th neighbour, that the fit tries.
FIT_HASHES, FIT_WIDTHS = (2, 4, 6, 8, 10, 12, 14, 16, 20, 24), (2.0, 2.5, 3.0, 4.0)


@dataclass
class Hashing:
    """Tables of ``len(multipliers[0])`` p-stable hashes floor((a . x + b) / width) each, folded to one 64-bit bucket."""

    directions: np.ndarray  # (tables, hashes, dimensions)
    offsets: np.ndarray  # (tables, hashes)
    multipliers: np.ndarray  # (tables, hashes), unsigned
    width: float

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(table, vector, hash): place on each line in units of the width."""
        return np.einsum("nd,thd->tnh", vectors, self.directions) / self.width + self.offsets[:, None, :]

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """(table, vector): bucket of the cell each place is in."""
        whole = np.floor(cells).astype(np.int64).view(np.uint64)
        return (whole * self.multipliers[:, None, :]).sum(axis=2, dtype=np.uint64)

    def probes(self, cells: np.ndarray, count: int) -> list[int]:
        """Of one query, in every table: its own bucket and the perturbed ones in order of estimated success."""
        out: list[int] = []
        own = self.buckets(cells[:, None, :])[:, 0]
        for t in range(len(own)):
            step = self.multipliers[t].tolist()
            base = int(own[t])
            out += [base + sum(sign * step[line] for line, sign in moves) for moves in perturbations(cells[t] - np.floor(cells[t]), count)]
        return out


def perturbations(below: np.ndarray, count: int) -> list[list[tuple[int, int]]]:
    """The first ``count`` sets of moves (line, -1 or 1) from a place, given by its distances to the lower edge of its cell on each line.

    The chance that a neighbour lies one cell below or above falls with the
    squared distance to that cell's edge; sets are listed by the sum of theirs, the empty one first.
    """
    m = len(below)
    cost = np.concatenate([below**2, (1 - below) ** 2])
    order = np.argsort(cost, kind="stable")
    price, move = cost[order].tolist(), [(o % m, -1 if o < m else 1) for o in order.tolist()]
    found: list[list[tuple[int, int]]] = [[]]
    heap = [(price[0], (0,))]
    while heap and len(found) < count:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({move[i][0] for i in chosen}) == len(chosen):
            found.append([move[i] for i in chosen])
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - price[last] + price[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + price[last + 1], (*chosen, last + 1)))
    return found


def meeting_chances(hashes: int, width: float, probes: int, distances: list[float], rng: np.random.Generator, places: int = 16, draws: int = 1000) -> list[float]:
    """For each distance the chance that a vector so far from a query lies in a bucket that the query visits in one table."""
    hits = np.zeros(len(distances))
    for _ in range(places):
        below = rng.uniform(0, 1, hashes)
        visited = set()
        for moves in perturbations(below, probes):
            cell = [0] * hashes
            for line, sign in moves:
                cell[line] = sign
            visited.add(tuple(cell))
        for i, distance in enumerate(distances):
            cells = np.floor(below + rng.normal(size=(draws, hashes)) * (distance / width)).astype(np.int64)
            hits[i] += sum(c in visited for c in map(tuple, cells[(np.abs(cells) <= 1).all(axis=1)].tolist()))
    return (hits / (places * draws)).tolist()


def neighbour_distances(sample: np.ndarray, rows: int, k: int) -> tuple[float, float]:
    """The expected distance of the k-th neighbour among ``rows`` vectors, and the median distance, from a sample.

    The sample's neighbours of rank r stand for those of rank r * rows / sample;
    nearer ones are extrapolated by the growth of the distance with the rank.
    """
    if len(sample) < 2:
        return 1.0, 1.0
    some = sample[:256]
    squares = np.maximum((some**2).sum(1)[:, None] + (sample**2).sum(1)[None, :] - 2 * some @ sample.T, 0)
    by_rank = np.median(np.sqrt(np.sort(squares, axis=1)[:, 1:]), axis=0)
    rank = k * len(sample) / max(rows, len(sample))
    low, high = min(4, len(by_rank)), min(64, len(by_rank))
    near, far = float(by_rank[low - 1]), float(by_rank[high - 1])
    if near <= 0 or far <= near:
        found = float(by_rank[min(max(int(np.ceil(rank)), 1), len(by_rank)) - 1])
    else:
        found = near * (rank / low) ** (np.log(far / near) / np.log(high / low))
    typical = float(np.median(np.sqrt(squares)))
    return found or typical or 1.0, typical or 1.0


def fit_hashing(sample: np.ndarray, rows: int, tables: int, probes: int, k: int, recall: float, seed: int) -> Hashing:
    """Number of hashes and width for which ``tables`` tables reach ``recall`` at the k-th neighbour and meet the fewest other rows.

    The chances are estimated for the distances that the sample leads one to
    expect among ``rows`` vectors, so cells get finer as rows get denser.
    """
    rng = np.random.default_rng(seed)
    near, typical = neighbour_distances(sample, rows, k)
    needed = 1 - (1 - recall) ** (1 / tables)
    best = None
    for hashes in FIT_HASHES:
        for ratio in FIT_WIDTHS:
            hit, other = meeting_chances(hashes, ratio * near, probes, [near, typical], rng)
            good = hit >= needed
            order = (not good, other if good else -hit)
            if best is None or order < best[0]:
                best = order, hashes, ratio * near
    _, hashes, width = best
    return Hashing(
        rng.normal(size=(tables, hashes, sample.shape[1])),
        rng.uniform(0, 1, (tables, hashes)),
        rng.integers(1, 2**63, (tables, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        width,
    )


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _hash_rows(hashing: Hashing, probes: int | None):
    """Each vector with the buckets it stands in, or those its query probes."""
    schema = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float64())), ("buckets", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch.column("vec"))
            cells = hashing.cells(vectors)
            if probes is None:
                found = hashing.buckets(cells).T.copy().view(np.int64)
            else:
                found = [np.array([p % 2**64 for p in hashing.probes(cells[:, i], probes)], dtype=np.uint64).view(np.int64) for i in range(len(vectors))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(list(found), pa.list_(pa.int64()))], schema=schema
            )

    return run


def _nearest_in_buckets(k: int):
    """Exact distances within each (bucket, block, block); the k + 1 nearest classes of each query that a task has met.

    Whole buckets are gathered up to HELD_ROWS rows; then each query is compared once with the different classes that its buckets hold.
    """
    schema = pa.schema([("query", pa.int64()), ("cls", pa.int64()), ("score", pa.float64())])

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def solve(keys: np.ndarray, asks: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            met: dict[int, list[tuple[int, int]]] = {}
            at: dict[int, int] = {}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                middle = a + int(np.searchsorted(asks[a:b], True))
                if a < middle < b:
                    for i, query in enumerate(ids[middle:b].tolist(), middle):
                        met.setdefault(query, []).append((a, middle))
                        at[query] = i
            for query, places in met.items():
                own = np.concatenate([np.arange(a, b) for a, b in places])
                classes, first = np.unique(ids[own], return_index=True)
                dist = np.sqrt(((vectors[own[first]] - vectors[at[query]]) ** 2).sum(axis=1))
                if query in best:
                    seen, scores = best[query]
                    fresh = ~np.isin(classes, seen)
                    classes, dist = np.concatenate([seen, classes[fresh]]), np.concatenate([scores, dist[fresh]])
                if len(classes) > k + 1:
                    top = np.lexsort((classes, dist))[: k + 1]
                    classes, dist = classes[top], dist[top]
                best[query] = classes, dist

        def flush():
            found = [(q, c, s) for q, (ids, dist) in best.items() for c, s in zip(ids.tolist(), dist.tolist(), strict=True)]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "bx", "bq")], axis=1)
            asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("is_query", "id"))
            held.append((keys, asks, ids, _matrix(batch.column("vec"))))
            size += len(batch)
            if size >= HELD_ROWS:
                keys, asks, ids, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
                open_at = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
                if open_at:
                    solve(keys[:open_at], asks[:open_at], ids[:open_at], vectors[:open_at])
                held = [(keys[open_at:], asks[open_at:], ids[open_at:], vectors[open_at:])]
                size = len(keys) - open_at
                if len(best) > HELD_QUERIES:
                    yield flush()
        if held:
            solve(*(np.concatenate(c) for c in zip(*held, strict=True)))
        if best:
            yield flush()

    return run


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    tables: int = 16,
    probes: int = 100,
    recall: float = 0.97,
    sample: int = 4096,
    seed: int = 1,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """For each row of ``vectors`` that meets ``queries``: its ``k`` nearest other rows by Euclidean distance.

    Rows ``(query_id, rank, vec_id, score)``, nearest first, ties to the
    smaller id; ``score`` is exact, in double precision.

    Equal vectors are one class in the index, with their k + 1 least ids.
    Every class stands in one bucket of each table; a query visits its bucket
    and perturbed ones, in order of estimated success.  Buckets are dealt by
    key, large ones in blocks; a task compares exactly and passes on each
    query's best k + 1 classes.  Number of hashes and width are fitted on at most
    ``sample`` vectors drawn by seeded hash and on the number of rows, so that
    ``recall`` is expected at the k-th neighbour; every row is indexed.  A query
    that met fewer than ``k`` rows is compared with all rows, in blocks.

    Null ids, and vectors null, empty, zero or with null or non-finite
    components take no part; vectors of another length than most of the sample
    neither.  Rows repeated whole count once; of different vectors under one id
    the least (in array order) stands.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("raw"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("raw")))
    out = "query_id long, rank int, vec_id long, score double"
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").select(F.col("raw").cast("array<double>").alias("raw")).limit(sample).toArrow()
    lengths = [len(v) for v in drawn.column("raw")]
    if not lengths:
        return spark.createDataFrame([], out)
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows = rows.where(F.size("raw") == d).groupBy("id").agg(F.min("raw").alias("raw"), F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    rows = staged(rows, "vectors")
    hashing = fit_hashing(np.array([v for v in drawn.column("raw").to_pylist() if len(v) == d]), rows.count(), tables, probes, k, recall, seed)
    least = Window.partitionBy("raw").orderBy("id")
    classes = staged(
        rows.select("id", "raw")
        .withColumn("r", F.dense_rank().over(least))
        .where(F.col("r") <= k + 1)
        .groupBy("raw")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
        .select(F.get("ids", F.lit(0)).alias("id"), "ids", F.col("raw").cast("array<double>").alias("vec")),
        "classes",
    )
    asked = rows.where("asks").select("id", F.col("raw").cast("array<double>").alias("vec"))
    schema = "id long, vec array<double>, buckets array<bigint>"
    index = staged(classes.select("id", "vec").mapInArrow(_hash_rows(hashing, None), schema), "index")
    probed = staged(asked.mapInArrow(_hash_rows(hashing, probes), schema), "probes")
    sizes = (
        index.select(F.explode("buckets").alias("bucket"), F.lit(1).alias("nx"), F.lit(0).alias("nq"))
        .unionByName(probed.select(F.explode("buckets").alias("bucket"), F.lit(0).alias("nx"), F.lit(1).alias("nq")))
        .groupBy("bucket")
        .agg(F.sum("nx").alias("nx"), F.sum("nq").alias("nq"))
    )
    large = staged(
        sizes.where((F.col("nq") > 0) & (F.col("nx") > 0) & ((F.col("nx") > BLOCK_ROWS) | (F.col("nq") > BLOCK_QUERIES))).select(
            F.col("bucket").alias("b"), F.ceil(F.col("nx") / BLOCK_ROWS).alias("kx"), F.ceil(F.col("nq") / BLOCK_QUERIES).alias("kq")
        ),
        "large",
    )

    def dealt(side: DataFrame, asks: bool) -> DataFrame:
        own, other = ("bq", "bx") if asks else ("bx", "bq")
        kown, kother = ("kq", "kx") if asks else ("kx", "kq")
        return (
            side.select("id", "vec", F.explode("buckets").alias("bucket"))
            .join(large, F.col("bucket") == F.col("b"), "left")
            .withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce(kown, F.lit(1))))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(kother, F.lit(1)) - 1)))
            .select("bucket", "bx", "bq", F.lit(asks).alias("is_query"), "id", "vec")
        )

    met = (
        dealt(index, False)
        .unionByName(dealt(probed, True))
        .repartition("bucket", "bx", "bq")
        .sortWithinPartitions("bucket", "bx", "bq", "is_query", "id")
        .mapInArrow(_nearest_in_buckets(k), "query long, cls long, score double")
    )
    found = staged(_best(met, classes, k), "found")
    counted = asked.select(F.col("id").alias("query_id")).join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    short = staged(counted.where(F.coalesce("n", F.lit(0)) < k).select("query_id"), "short")
    if not short.isEmpty():
        again = _best(_compared_with_all(asked.join(short, F.col("id") == F.col("query_id")), classes, k), classes, k)
        found = found.join(short, "query_id", "left_anti").unionByName(again)
    drop(index, probed, large)
    return found


def _best(met: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query from scored classes."""
    once = met.groupBy("query", "cls").agg(F.min("score").alias("score"))
    by_class = Window.partitionBy("query").orderBy("score", "cls")
    near = once.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    ids = near.join(classes.select(F.col("id").alias("cls"), "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("query").orderBy("score", "vec_id")
    return (
        ids.where("vec_id <> query")
        .withColumn("rank", F.row_number().over(by_row))
        .where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _dealt_with_all(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """Every class beside every query, in blocks ``(bucket, bx, bq)`` of about BLOCK_ROWS classes and BLOCK_QUERIES queries."""
    blocks, parts = -(-classes.count() // BLOCK_ROWS), -(-asked.count() // BLOCK_QUERIES)

    def dealt(side: DataFrame, asks: bool) -> DataFrame:
        own, n_own, other, n_other = ("bq", parts, "bx", blocks) if asks else ("bx", blocks, "bq", parts)
        return (
            side.select("id", "vec", F.lit(0).cast("long").alias("bucket"))
            .withColumn(own, F.pmod(F.xxhash64("id"), F.lit(max(n_own, 1)).cast("long")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_other, 1) - 1).cast("long"))))
            .select("bucket", "bx", "bq", F.lit(asks).alias("is_query"), "id", "vec")
        )

    return dealt(classes, False).unionByName(dealt(asked, True))


def _compared_with_all(asked: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Every class scored for each of the queries, block by block."""
    return (
        _dealt_with_all(asked, classes)
        .repartition("bucket", "bx", "bq")
        .sortWithinPartitions("bucket", "bx", "bq", "is_query", "id")
        .mapInArrow(_nearest_in_buckets(k), "query long, cls long, score double")
    )
