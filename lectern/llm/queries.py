"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    alignment, clusters, decontamination, exact_dedup, html_text, minhash, packing, quality, sharding, substring_dedup, token_files,
    tokens, toxicity,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.length_histogram(tokens.token_lengths(table(spark, folder, "documents")))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Sources are hosts; what a source has in one language is a path of it."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.quality(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.byte_shards(table(spark, folder, "documents"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op10_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles, similarity 0.85."""
    return minhash.near_groups(table(spark, folder, "documents"), words=3, percent=85)


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster(table(spark, folder, "embeddings"))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return token_files.written_and_read(table(spark, folder, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_corpus(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_substring_dedup,
        op3_token_counts,
        op4_packing,
        op5_exact_dedup,
        op6_quality,
        op7_decontamination,
        op8_sharding,
        op9_html_extraction,
        op10_minhash_dedup,
        op11_centroid_clustering,
        op12_token_files,
        op13_tokenizer_alignment,
    )
}

SQL = {
    "op11_centroid_clustering": clusters.sql(),
    "op5_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)""",
}
