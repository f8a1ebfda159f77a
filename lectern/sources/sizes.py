"""Sizes of artifacts: of rows that hold them, and of files without reading their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of every file below a folder; the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def artifact_bytes(artifacts: DataFrame) -> DataFrame:
    """Number and total bytes of the artifacts of each book; artifacts(book_id, content)."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    return artifacts.groupBy("book_id").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
