"""Write, audit, publish: package versions of books in a shared folder.

A folder holds ``staged`` (one folder per attempt), ``versions`` (published
packages, never changed) and ``active`` (one small pointer file per book).  An
attempt writes its candidates to ``staged`` in one job, reads them back and
compares them with what was meant to be written, and only then moves each
passing package to ``versions`` and swaps the book's pointer by one atomic
rename.  Whatever fails before the swap, readers keep the version they had; an
attempt that is repeated finds its work done.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import durable

DOCUMENTS = "book_id string, version_id string, document string, pos bigint, json string"
POINTER = "book_id string, version_id string, seq bigint, package string"
THREADS = 16


def package_key(book: str = "book_id", version: str = "version_id") -> Column:
    """Folder name of a version."""
    return F.sha2(F.concat_ws("\n", F.col(book).cast("string"), F.col(version).cast("string")), 256)


def sealed(documents: DataFrame) -> DataFrame:
    """(book_id, version_id, rows, digest): what a complete package must hold, whatever the order of its rows."""
    row = F.xxhash64("document", "pos", "json").cast("decimal(38,0)")
    return documents.groupBy("book_id", "version_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("digest"))


def stage(documents: DataFrame, root: str) -> str:
    """Write documents(book_id, version_id, document, pos, json) to a new attempt; returns its folder."""
    attempt = f"{root}/staged/{uuid.uuid4().hex}"
    rows = documents.select("book_id", "version_id", "document", "pos", "json", package_key().alias("package"))
    rows.repartitionByRange("package", "document", "pos").sortWithinPartitions("package", "document", "pos").write.partitionBy(
        "package"
    ).parquet(attempt)
    return attempt


def audit(spark: SparkSession, attempt: str, candidates: DataFrame) -> DataFrame:
    """Each candidate with its error or null, from what was really written.

    candidates(book_id, version_id, seq, complete, violations, source_hash, rows,
    digest); a version id starts with the first 16 characters of its source hash.
    """
    written = sealed(spark.read.schema(f"{DOCUMENTS}, package string").parquet(attempt))
    found = written.select("book_id", "version_id", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    joined = candidates.join(found, ["book_id", "version_id"], "left")
    whole = (F.col("rows") == F.col("_rows")) & F.col("digest").eqNullSafe(F.col("_digest"))
    error = (
        F.when(~F.coalesce("complete", F.lit(False)), "incomplete")
        .when(F.coalesce("violations", F.lit(1)) != 0, "violations")
        .when(~F.coalesce(F.col("version_id").startswith(F.substring("source_hash", 1, 16)), F.lit(False)), "foreign_version")
        .when(~F.coalesce(whole, F.lit(False)), "torn_write")
    )
    return joined.select("book_id", "version_id", "seq", package_key().alias("package"), error.alias("error"))


class Store:
    """The few file-system calls of a publication, through Hadoop's own interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self.path(root).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        self.replacing = spark.sparkContext._gateway.new_array(rename, 1)
        self.replacing[0] = rename.OVERWRITE

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def move(self, source: str, target: str) -> None:
        """A package that is there already stays: a version id names one content."""
        if self.system.exists(self.path(target)):
            return
        self.system.mkdirs(self.path(target).getParent())
        if not self.system.rename(self.path(source), self.path(target)) and not self.system.exists(self.path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def pointer(self, name: str) -> dict | None:
        target = self.path(f"{self.root}/active/{name}.json")
        if not self.system.exists(target):
            return None
        stream = self.system.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def swap(self, name: str, value: dict) -> None:
        """Readers see the old pointer or the new one, never none and never half of one."""
        folder = f"{self.root}/active"
        self.system.mkdirs(self.path(folder))
        fresh = self.path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        stream = self.system.create(fresh)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        self.context.rename(fresh, self.path(f"{folder}/{name}.json"), self.replacing)

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def publish(spark: SparkSession, root: str, attempt: str, audited: DataFrame) -> int:
    """Make the newest passing candidate of every book its active version; returns how many pointers changed.

    A book whose active version has the same or a later ``seq`` keeps it.  One
    package and one pointer are moved per book, by a few threads of the driver;
    names only pass through it.
    """
    best = audited.where("error is null").groupBy("book_id").agg(F.max_by(F.struct("version_id", "seq", "package"), "seq").alias("v"))
    store = Store(spark, root)

    def one(row) -> bool:
        name = row["name"]
        now = store.pointer(name)
        if now is not None and now["seq"] >= row["seq"]:
            return False
        store.move(f"{attempt}/package={row['package']}", f"{root}/versions/package={row['package']}")
        store.swap(name, {k: row[k] for k in ("book_id", "version_id", "seq", "package")})
        return True

    rows = best.select(F.col("book_id").cast("string").alias("book_id"), "v.*", F.sha2(F.col("book_id").cast("string"), 256).alias("name"))
    with ThreadPoolExecutor(THREADS) as pool:
        changed = sum(pool.map(one, rows.toLocalIterator()))
    store.delete(attempt)
    return changed


def active_versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per book with a published version."""
    store = Store(spark, root)
    if not store.system.exists(store.path(f"{root}/active")):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).json(f"{root}/active")


def read_active(spark: SparkSession, root: str) -> DataFrame:
    """Documents of every book's active version; other versions' folders are pruned by the join."""
    active = active_versions(spark, root)
    if active.isEmpty():
        return spark.createDataFrame([], DOCUMENTS)
    rows = spark.read.schema(f"{DOCUMENTS}, package string").parquet(f"{root}/versions")
    return rows.join(active.select("package"), "package", "left_semi").drop("package")


def run(spark: SparkSession, root: str, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """One whole attempt: (book_id, version_id, seq, package, error) of its candidates."""
    attempt = stage(documents, root)
    outcome = audit(spark, attempt, candidates.join(sealed(documents), ["book_id", "version_id"], "left"))
    outcome = durable(outcome)  # the staged folder goes with the publication
    publish(spark, root, attempt, outcome)
    return outcome
