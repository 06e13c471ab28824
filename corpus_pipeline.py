"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._stage import staged
from quillon.llm.ngram_jaccard_join import ngram_jaccard_join, with_digest
from quillon.llm.packing import pack
from quillon.llm.quality_classifier import fit_quality_model, score_quality
from quillon.llm.secret_scan import redact_secrets
from quillon.llm.source_mixing import mix_sources, repeat_documents, word_count


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their own labels, keeps."""
    model = fit_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of those of least doc_id (none comes last) one; rows without words all.

    The decision is made by row: a text is known by its doc_id and the digest of
    its n-grams, so different texts under one doc_id are told apart.
    """
    found = ngram_jaccard_join(docs).where("digest is not null")
    key = [F.col("doc_id").isNull().alias("_noid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("_digest")]
    best = found.withColumnRenamed("digest", "_digest").groupBy("group_key").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    stays = staged(best, "stays")
    columns = docs.columns
    rows = with_digest(docs.toDF(*[f"_k{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(columns)]), name="_digest")
    row = F.struct(*rows.drop("_digest").columns).alias("row")
    hashable = [f.name for f in rows.schema if "map" not in f.dataType.simpleString()]
    whole = rows.select(*key, row, F.struct("text", F.xxhash64(*hashable)).alias("_order"))
    # Rows alike in doc_id and digest shrink to one before they are shuffled.
    once = whole.where("_digest is not null").groupBy("_noid", "_id", "_digest").agg(F.min_by("row", "_order").alias("row"))
    kept = once.join(stays, ["_noid", "_id", "_digest"], "left_semi").select("row").unionByName(whole.where("_digest is null").select("row"))
    return kept.select("row.*").toDF(*columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    columns = [c for c in docs.columns if c != "size"]
    sized = docs.select(*columns).withColumn("size", word_count(F.col("text")))
    return repeat_documents(mix_sources(sized), columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of fixed length, as pieces of documents."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]
#: The classifier and the MinHash join have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
