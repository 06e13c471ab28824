"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_extraction import extract_articles
from .nearest_neighbours import nearest_neighbours
from .ngram_jaccard_join import ngram_jaccard_join
from .oracle import PREFIX_TRIE
from .packing import pack
from .pii import pseudonymize
from .prefix_trie import digest_trie, shared_starts, turn_digests
from .quality_classifier import fit_quality_model, score_quality
from .quality_rules import quality_rules
from .secret_scan import secret_scan, span_text
from .source_mixing import mix_sources, word_count
from .substring_dedup import substring_dedup
from .token_alignment import align_tokens
from .token_files import token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents")).drop("digest", "group_key")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality_model(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, model).drop("text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_articles(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: The key of the query; a real run passes its own secret.
PSEUDONYM_KEY = b"quillon example key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, PSEUDONYM_KEY)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents")).drop("ids")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    mixed = mix_sources(docs)
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(_table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"),
        span_text(F.concat("base_spans", "linked_spans")).alias("spans"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = turn_digests(_table(spark, sf_dir, "conversations"))
    return digest_trie(shared_starts(digests), digests.select("conv_id"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_source_mixing": op8_source_mixing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_secret_scan": op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_files": op12_token_files,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": PREFIX_TRIE}
