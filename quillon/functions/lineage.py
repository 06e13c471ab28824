"""Cutting a plan's lineage where a loop would let it grow, or where a table is read many times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: By application: paths of the tables that ``cut`` has left.
_LEFT: dict[str, set[str]] = {}
#: By application: tables that ``kept`` has written, by what they are made of.
_KEPT: dict[str, dict[tuple, DataFrame]] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that ``spark.checkpoint.dir`` names, and read again; in local mode to one of our own where it is unset.

    Unlike a checkpointed RDD the table is read by column, and its size is known to the optimizer.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/quillon-cut/{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    _LEFT.setdefault(context.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, cut once a session for each ``key`` (what it is made of), until ``release``."""
    tables = _KEPT.setdefault(spark.sparkContext.applicationId, {})
    if key not in tables:
        tables[key] = cut(build())
    return tables[key]


def release(spark: SparkSession) -> None:
    """Remove every table this application has cut; call it when results that read them are written."""
    _KEPT.pop(spark.sparkContext.applicationId, None)
    left = _LEFT.pop(spark.sparkContext.applicationId, set())
    for name in left:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
