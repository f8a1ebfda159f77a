"""Token files: Parquet list columns in ascending order of ids, read selectively by id or by place.

A folder holds ``tokens`` and ``index``.  ``tokens`` has one row per document:
doc_id, part (number of the file), before (ids before it in its file), n_tokens
(with the end id) and ids, a list of ids.  Lists are dictionary-encoded, so an
id takes as many bits as its row group has different ids; the ascending numbers
are delta-encoded.  Row groups are bounded in bytes and rows and pages in rows,
and Parquet's page indexes hold the limits of each page, so a filter on doc_id or
before skips files, row groups and pages, and metadata is read without touching
the lists.  ``index`` has one row per file: its first and last doc_id, its
numbers of documents and ids, and ``first``, the ids in all files before it.

Input: rows with an id and a text.  Null and empty texts are documents of the end
id alone.  Null ids come first; rows that repeat an id follow one another in the
order of the input, however many they are.  Extra columns are not read.  An empty
table makes an empty folder that reads back as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.byte_level import byte_coder
from lectern.llm.common import empty_text, scratch

END = 2
FLUSH = 1 << 22  # ids in one Arrow batch
TOKENS = "doc_id long, part int, before long, n_tokens long, ids array<int>"
INDEX = "part int, first_id long, last_id long, n_docs long, n_tokens long, first long"
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.block.row.count.limit": "20000",
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#before": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(
    docs: DataFrame, folder: str, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None,
) -> str:
    """Encode every whole text and write the folder; one file per range of ids (``files``: else as the shuffle is set)."""
    path = path or default_path()
    schema = pa.schema([
        ("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))
    ])

    def batch(ids: list, raw: list[bytes], part: int, before: int) -> pa.RecordBatch:
        n = np.array([len(x) // 4 for x in raw], np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
        columns = [pa.array(ids, pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends[:-1]), pa.array(n), lists]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, before = byte_coder(path), TaskContext.get().partitionId(), 0
        last = np.array([end], "<i4").tobytes()
        for given in batches:
            ids, raw, held = [], [], 0
            for i, text in zip(given.column(0).to_pylist(), given.column(1), strict=True):
                ids.append(i)
                raw.append(code.ids(text.as_py()) + last)
                held += len(raw[-1]) // 4
                if held >= FLUSH:
                    yield batch(ids, raw, part, before)
                    before, ids, raw, held = before + held, [], [], 0
            if ids:
                yield batch(ids, raw, part, before)
                before += held

    # The place in the input keeps a much repeated id from being one range.
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), empty_text(text_col).alias("text"), F.monotonically_increasing_id().alias("place")
    )
    ordered = rows.repartitionByRange(*([files] if files else []), "id", "place").sortWithinPartitions("id", "place")
    ordered.select("id", "text").mapInArrow(run, TOKENS).write.options(**LAYOUT).parquet(f"{folder}/tokens")
    spark = docs.sparkSession
    per = spark.read.schema(TOKENS).parquet(f"{folder}/tokens").groupBy("part").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    per.withColumn("first", F.coalesce(F.sum("n_tokens").over(along), F.lit(0))).write.parquet(f"{folder}/index")
    return folder


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; ``low`` and ``high`` bound doc_id, both included.

    Columns that a query does not ask for are not read: without ``ids`` this is
    the metadata.  The bounds reach the files' statistics and page indexes.
    """
    rows = spark.read.schema(TOKENS).parquet(f"{folder}/tokens")
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    first = read_index(spark, folder).select("part", "first")  # one row per file
    return rows.join(F.broadcast(first), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """The ids at places ``start`` to ``stop`` - 1 of the whole: doc_id, start and ids of each document's share."""
    found = read_index(spark, folder).where((F.col("first") < stop) & (F.col("first") + F.col("n_tokens") > start))
    low, high = found.agg(F.min("part"), F.max("part")).first()
    rows = spark.read.schema(TOKENS).parquet(f"{folder}/tokens")
    # Files of one row group hold one part, so the bounds skip all others.
    rows = rows.where(F.col("part").between(low, high)) if low is not None else rows.where("false")
    at = F.col("first") + F.col("before")
    rows = rows.join(F.broadcast(found.select("part", "first")), "part").select("doc_id", at.alias("at"), "n_tokens", "ids")
    rows = rows.where((F.col("at") < stop) & (F.col("at") + F.col("n_tokens") > start))
    skipped = F.greatest(F.lit(start) - F.col("at"), F.lit(0))
    taken = F.least(F.col("at") + F.col("n_tokens"), F.lit(stop)) - F.col("at") - skipped
    return rows.select(
        "doc_id", (F.col("at") + skipped).alias("start"), F.slice("ids", (skipped + 1).cast("int"), taken.cast("int")).alias("ids")
    )


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows as ``read_tokens`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            lists = given.column(3)
            ends = lists.offsets.to_numpy()
            values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).view(np.uint8))
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [given.column(0), given.column(1), given.column(2), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest rows of all documents from files in the shared folder, which go with the session."""
    spark = docs.sparkSession
    folder = write_tokens(docs, scratch(spark, "token-files"), path)
    return digests(read_tokens(spark, folder))
