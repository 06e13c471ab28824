"""Intermediate tables in the shared folder, and session settings the operators rely on."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows per Arrow batch: a batch stays small even when texts are long.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_ROWS = 500
#: And bytes per batch, which both the JVM and the worker hold.
_BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_BYTES = 8 << 20
#: A join whose smaller side has partitions of at most this size hashes them, by their measured size, instead of sorting both.
_HASH_JOIN = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
_HASH_JOIN_SIZE = "48m"
#: By application: paths of the staged tables that are still there.
_LEFT: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode one of our own where it is unset.

    On a cluster a folder of one machine would lose what other machines write, so the setting has to be made there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers, and let small measured partitions be hashed, in the plans made from now on."""
    if int(spark.conf.get(_BATCH)) > _BATCH_ROWS:
        spark.conf.set(_BATCH, str(_BATCH_ROWS))
    spark.conf.set(_BATCH_SIZE, f"{_BATCH_BYTES}b")
    spark.conf.set(_HASH_JOIN, _HASH_JOIN_SIZE)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the jobs run inside go when these end."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    Shuffle files of the job go when it ends.  ``drop`` removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    keep_until_release(spark, path)
    return out


def keep_until_release(spark: SparkSession, path: str) -> None:
    """Let ``release`` remove this folder."""
    _LEFT.setdefault(spark.sparkContext.applicationId, set()).add(path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _LEFT.get(spark.sparkContext.applicationId, set()).discard(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``staged`` that no later plan reads."""
    for table in tables:
        _remove(table.sparkSession, table._quillon_path)


def release(spark: SparkSession) -> None:
    """Remove every table this application's operators have left; call it when their results are written, as results read them."""
    for path in list(_LEFT.get(spark.sparkContext.applicationId, ())):
        _remove(spark, path)


def worker_state(owner: str) -> dict:
    """What a Python worker keeps for ``owner`` from task to task (Spark reuses workers); called in tasks.

    What it has kept for another operator is let go first, so that a worker never holds two operators' tables.
    """
    held = vars(sys.modules.setdefault("quillon_worker_state", types.ModuleType("quillon_worker_state")))
    if held.get("owner") != owner:
        held |= {"owner": owner, "kept": {}}
    return held["kept"]
