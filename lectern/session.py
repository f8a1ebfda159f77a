"""Session helpers: input splitting, size-checked broadcast, durable cuts in the shared folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int = 8, app: str = "lectern") -> SparkSession:
    """Local session used by tests and bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that setting is
    absent (local tests) is a temporary folder made.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # local-cluster has executors of its own: only one process may use a folder of its own.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="lectern-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder (survives executor loss).

    One job writes it; readers keep column pruning, pushed filters and sizes for
    the planner.  The folder goes with ``forget``, at the latest when the driver's
    file system closes.  Columns without a type become strings.
    """
    spark = df.sparkSession
    void = {f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if f.dataType.typeName() == "void"}
    rows = df.withColumns(void) if void else df
    path = f"{checkpoint_dir(spark)}/lectern-cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    table = spark.read.schema(rows.schema).parquet(path)
    table.cut_at = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete cuts that nothing reads any more."""
    for table in tables:
        path = getattr(table, "cut_at", None)
        if path is not None:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Split an under-partitioned scan over the cores.

    A table of one row group scans in one task.  On a large table the scan has
    more splits than cores, so this adds no shuffle there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000, probe: DataFrame | None = None) -> DataFrame:
    """Broadcast ``df`` only after counting that it is small.

    ``probe`` is a cheaper DataFrame known to have at least as many rows.  Above
    the bound the side is returned without a hint and the join shuffles.
    """
    side = df if probe is None else probe
    if is_small(side, max_rows):
        return F.broadcast(df)
    return df


def is_small(df: DataFrame, max_rows: int = 500_000) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def join_picked(df: DataFrame, picked: DataFrame, on: list[str], max_rows: int = 500_000) -> DataFrame:
    """Inner join of a large table with the rows that were chosen from it.

    A small choice is broadcast.  Of a large one a bitmap of its hashed keys is, so that
    of ``df`` hardly more rows than are wanted reach the shuffle of the join.
    """
    if is_small(picked, max_rows):
        return df.join(F.broadcast(picked), on)
    return _maybe_among(df, picked, on).join(picked, on)


def _maybe_among(df: DataFrame, picked: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is among those of ``picked``, and of the others about one in 16 up to 17 million keys."""
    bits = min(28, max(16, (16 * picked.count()).bit_length()))
    part, at = F.lit(1 << 15), F.pmod(F.xxhash64(*on), F.lit(1 << bits))
    rows = picked.select((at / part).cast("long").alias("_part"), (at % part).alias("_at"))
    maps = durable(rows.groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_map")))
    hashed = df.withColumns({"_part": (at / part).cast("long"), "_at": at % part}).join(F.broadcast(maps), "_part")
    byte = "cast(conv(hex(substring(_map, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)"
    return hashed.where(f"(shiftright({byte}, cast(_at % 8 as int)) & 1) = 1").select(*df.columns)
