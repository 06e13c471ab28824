"""Filings as they arrive: each is parsed once, however often a run is repeated or breaks off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillon.sources.xbrl import parse_instances

KEYS = ("cik", "accession")
_FILES = "path string, modificationTime timestamp, length long, content binary"
_LEDGER = "cik string, accession string, status string, batch long"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """``cik, accession, status, batch`` of every filing that a committed or begun batch has read."""
    return _read(spark, f"{folder}/ledger", _LEDGER)


def records(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The parsed elements of all filings read so far, with their ``batch``."""
    from quillon.sources.xbrl import RECORDS

    return _read(spark, f"{folder}/records", schema or f"cik string, accession string, {RECORDS}, batch long")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


def append_batch(filings: DataFrame, batch: int, folder: str, parse: Callable[[DataFrame], DataFrame] = parse_instances, again: tuple[str, ...] = ("xml_missing", "corrupt_xml")) -> None:
    """Parse the filings of one batch that no other batch has read, and write them under the batch's number.

    Writing replaces what an earlier attempt at the same batch left, so a batch
    that broke off after any step can be run again.  Filings are known by their
    keys: of several files of one filing in a batch the first by path counts, and
    one whose status is among ``again`` may be read once more in a later batch.
    """
    spark = filings.sparkSession
    done = ledger(spark, folder).where((F.col("batch") != batch) & ~F.col("status").isin(*again))
    first = filings.groupBy(*KEYS).agg(F.min("path").alias("path"))
    fresh = filings.join(first, [*KEYS, "path"], "left_semi").join(done.select(*KEYS).distinct(), list(KEYS), "left_anti")
    out = f"{folder}/records/batch={batch}"
    parse(fresh).write.mode("overwrite").parquet(out)
    ended = spark.read.parquet(out).where("kind = 'end'").select(*KEYS, F.col("detail").alias("status"))
    ended.write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch}")


def latest(parsed: DataFrame) -> DataFrame:
    """Records of each filing's last batch: where a corrupt file was read again, the later reading counts."""
    newest = parsed.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    return parsed.join(newest, [*KEYS, "batch"], "left_semi")


def ingest(spark: SparkSession, source: str, folder: str, files_a_batch: int = 1000, parse: Callable[[DataFrame], DataFrame] = parse_instances) -> StreamingQuery:
    """Read all instance files (``CIK_ACCESSION.xml``) that have come to ``source`` since the last run, then stop.

    A stream remembers the files it has seen under ``folder/progress``; each
    micro-batch goes through ``append_batch``, whose ledger keeps a filing from
    being read twice even where its file comes again under another name.
    """
    name = F.regexp_extract("path", r"([^/]+)\.xml$", 1)
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", files_a_batch).load(source)
    filings = files.select(F.split_part(name, F.lit("_"), F.lit(1)).alias("cik"), F.split_part(name, F.lit("_"), F.lit(2)).alias("accession"), "path", "content")
    writer = filings.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, folder, parse))
    return writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
