"""Reader, usage, budget and job streams.

Where the state is a commutative aggregate it is a streaming aggregate, so a
hot session combines map-side.  Where order matters, state is keyed by user,
run or book and a micro-batch is applied in the order of event time by the
processors of ``processors``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lectern.functions.numbers import wall_micros
from lectern.session import checkpoint_dir
from lectern.streaming.processors import Budget, Jobs, Progress, RateLimit, stateful


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table folder or file as a file stream with its own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}*.parquet")


def run_available(stream: DataFrame, mode: str = "update", path: str | None = None) -> DataFrame:
    """Process what is there, one table folder per epoch, and read it back with its epoch.

    Writing an epoch again replaces it, so a retried batch leaves no copies.
    """
    spark = stream.sparkSession
    root = path or f"{checkpoint_dir(spark)}/lectern-stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/epoch={epoch}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("epoch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/data")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Newest epoch of every key of an update-mode result."""
    values = [c for c in rows.columns if c not in keys and c != "epoch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return newest.select(*keys, "v.*")


def session_coverage_stream(read_events: DataFrame) -> DataFrame:
    """Largest endpoint per session and chapter; late and repeated events change nothing."""
    from lectern.operators.reading import coverage

    return coverage(read_events)


def session_state_stream(events: DataFrame) -> DataFrame:
    """Last location and mode by event time, revision one more per patch."""
    from lectern.operators.reading import session_state

    return session_state(events)


def usage_stream(requests: DataFrame, *, agent_micros: int, compile_micros: int, delay: str = "1 hour") -> DataFrame:
    """Requests, bytes and cost per hour and operation; requests(ts, operation, input_bytes, output_bytes)."""
    agent = F.col("operation").isin("explain", "ask", "reflect")
    micros = F.when(agent, agent_micros).when(F.col("operation") == "compile", compile_micros).otherwise(0).cast("long")
    return (
        requests.withColumn("at", F.timestamp_micros(wall_micros(F.col("ts"))))
        .withWatermark("at", delay)
        .groupBy(F.window("at", "1 hour").alias("w"), "operation")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.sum("input_bytes").alias("input_bytes"),
            F.sum("output_bytes").alias("output_bytes"),
            F.sum(micros).alias("estimated_cost_micros"),
        )
        .select(
            F.expr("unix_seconds(w.start) div 3600").alias("hour"),
            "operation",
            "request_count",
            "input_bytes",
            "output_bytes",
            "estimated_cost_micros",
        )
    )


def timed(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with ``at`` and its watermark; a feed that has ``at`` has its watermark already."""
    if "at" in rows.columns:
        return rows
    return rows.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", delay)


def rate_limit_stream(requests: DataFrame, *, limit: int, window_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Accept or refuse each request; state is the accepted times of the trailing window.

    requests(key, seq, ts_us).  A key's state is gone once the watermark has
    passed the end of its last window; requests older than the watermark get no
    decision.
    """
    rows = timed(requests.select("key", "seq", "ts_us", *[c for c in requests.columns if c == "at"]), delay)
    return stateful(rows, RateLimit(limit, window_seconds * 1_000_000), "key bigint, seq bigint, accepted boolean")


def budget_stream(events: DataFrame, limits: dict, *, keep_seconds: int | None = None, delay: str = "1 day") -> DataFrame:
    """Decision on every reservation and settlement of a run's calls.

    events(key, seq, ts_us, kind, call_id, input_bytes, known, tokens_in,
    tokens_out, nano_usd); kind is reserve / settle.  Reservations carry the
    size, settlements the usage.  Money is in whole billionths, so the threshold
    is exact.  reason: null for what is admitted or settled.  With
    ``keep_seconds`` a run without events for so long is forgotten.
    """
    keep = None if keep_seconds is None else keep_seconds * 1_000_000
    rows = events if keep is None else timed(events, delay)
    return stateful(rows, Budget(limits, keep), "key string, seq bigint, kind string, call_id string, reason string")


def job_state_stream(events: DataFrame, *, keep_seconds: int | None = None, delay: str = "1 day") -> DataFrame:
    """Decision on every compile request and the job state after every event.

    events(key, seq, ts_us, kind, analysis_key); kind is request / processing /
    ready / failed.  A request joins a running or finished job of the same key,
    conflicts with a running job of another key, and otherwise queues a new one.
    With ``keep_seconds`` a job without events for so long is forgotten.
    """
    keep = None if keep_seconds is None else keep_seconds * 1_000_000
    rows = events if keep is None else timed(events, delay)
    return stateful(rows, Jobs(keep), "key bigint, seq bigint, decision string, state string")


def session_progress_stream(patches: DataFrame, blocks: DataFrame) -> DataFrame:
    """Progress of a session after every accepted patch, from one stateful step.

    patches(session_id, book_id, seq, ts_us, spine_index, ord?, char_offset?,
    is_read).  Against the static prefix table of chapters a read location becomes
    a number of characters.  The state of a session holds how far each of its
    chapters has been read, which turns it into what the patch adds, and the
    progress.  Late and repeated patches add nothing but their revision.
    """
    from lectern.operators.reading import BLOCK, book_chars, chapter_prefix

    prefix = chapter_prefix(blocks).select(*BLOCK, "n_chars", "chars_before")
    place = F.col("chars_before") + F.least(F.coalesce("char_offset", F.lit(0)), F.col("n_chars"))
    rows = patches.join(prefix, BLOCK, "left").join(book_chars(blocks), "book_id", "left").select(
        "session_id", "book_id", F.col("spine_index").cast("string").alias("chapter"), "seq", "ts_us",
        F.when(F.col("is_read"), place).cast("long").alias("reach"), "total",
    )
    return stateful(
        rows, Progress(), "session_id string, book_id string, seq bigint, visible bigint, progress_basis_points bigint, revision bigint"
    )


def deduplicated(events: DataFrame, keys: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated deliveries of the same event within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def annotation_stream(highlights: DataFrame, blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Highlights checked against the static blocks, one error or null each."""
    from lectern.operators.reading import validate_highlights

    return validate_highlights(highlights, blocks, sessions)


def save_routes(root: str):
    """Writer of a micro-batch into one table per value of ``route``.

    One job writes all tables of an epoch into the epoch's folder, replacing what
    an earlier attempt left there, so a replayed epoch leaves no copies and no
    table is ahead of another.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{root}/data/epoch={epoch}")

    return save


def run_routes(stream: DataFrame, path: str | None = None) -> str:
    """Process what is there and return the folder; ``stream`` has a string column ``route``."""
    spark = stream.sparkSession
    root = path or f"{checkpoint_dir(spark)}/lectern-routes-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(save_routes(root))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return root


def read_route(spark: SparkSession, root: str, route: str, schema: StructType) -> DataFrame:
    """One of the tables; a route that no row took is an empty table."""
    fields = [f for f in schema.fields if f.name != "route"]
    whole = StructType([*fields, StructField("epoch", IntegerType()), StructField("route", StringType())])
    return spark.read.schema(whole).parquet(f"{root}/data").where(F.col("route") == route).drop("route")


def annotation_tables(highlights: DataFrame, blocks: DataFrame, sessions: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): one stream into two tables, rejects with their error."""
    checked = annotation_stream(highlights, blocks, sessions)
    routed = checked.withColumn("route", F.when(F.col("error").isNull(), "accepted").otherwise("rejected"))
    root = run_routes(routed, path)
    spark = highlights.sparkSession
    accepted, rejected = (read_route(spark, root, r, routed.schema) for r in ("accepted", "rejected"))
    return accepted.drop("error"), rejected
