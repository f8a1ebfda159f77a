"""Streams over the event table, run until all available input is processed."""

from pyspark.sql import functions as F

from lectern.functions import numbers
from lectern.operators import reading
from lectern.plans import base, reader
from lectern.plans import queries_reading as qr
from lectern.plans import queries_scoring as qs
from lectern.plans import suite_data
from lectern.plans.registry import query, view
from lectern.session import durable
from lectern.streaming import jobs


def stream_events(spark, folder):
    raw = jobs.read_table_stream(spark, folder, "events")
    return reader.mapped(raw)


@query("session_coverage_stream", "SELECT session_id, spine_index, end_ord, end_offset FROM v_coverage")
def session_coverage_stream(spark, folder):
    blocks = durable(base.blocks(spark, folder).select("book_id", "spine_index", "ord", "block_id", "n_chars"))
    located = reading.location_keys(stream_events(spark, folder).where("is_location"), durable(base.chapters(spark, folder)), blocks)
    accepted = located.where("error is null and event_type in ('view', 'click')")
    rows = jobs.run_available(jobs.session_coverage_stream(accepted))
    return jobs.latest(rows, ["session_id", "book_id", "spine_index"]).drop("book_id")


@query(
    "session_state_stream",
    """SELECT session_id, arg_max(spine_index, (ts, event_id)) FILTER (is_location) AS spine_index,
         arg_max(mode, (ts, event_id)) FILTER (mode IS NOT NULL) AS mode, count(*) + 1 AS revision
       FROM (SELECT session_id, ts, event_id, spine_index, ord, char_offset, mode, is_location FROM v_located WHERE error IS NULL
             UNION ALL SELECT session_id, ts, event_id, spine_index, ord, char_offset, mode, is_location FROM v_events WHERE NOT is_location)
       GROUP BY session_id""",
)
def session_state_stream(spark, folder):
    rows = jobs.run_available(jobs.session_state_stream(reader.patches(spark, folder, stream_events(spark, folder))))
    return jobs.latest(rows, ["session_id"]).select("session_id", "spine_index", "mode", "revision")


@query(
    "usage_stream",
    """SELECT epoch_us(ts) // 3600000000 AS hour, operation, count(*) AS request_count, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes,
         CAST(sum(CASE WHEN operation IN ('explain', 'ask', 'reflect') THEN 300 WHEN operation = 'compile' THEN 9000 ELSE 0 END) AS BIGINT) AS estimated_cost_micros
       FROM v_operations JOIN (SELECT event_id, ts FROM events) USING (event_id) GROUP BY ALL""",
)
def usage_stream(spark, folder):
    stream = jobs.usage_stream(qs.as_http(stream_events(spark, folder)), agent_micros=300, compile_micros=9000)
    return jobs.latest(jobs.run_available(stream), ["hour", "operation"])


@query("rate_limit_stream", "SELECT user_id, event_id, accepted FROM v_rate")
def rate_limit_stream(spark, folder):
    rows = stream_events(spark, folder).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), numbers.wall_micros(F.col("ts")).alias("ts_us")
    )
    done = jobs.run_available(jobs.rate_limit_stream(rows, limit=3, window_seconds=86_400, delay="40 days"), "append")
    return done.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "accepted")


view(
    "v_budget_events",
    """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS pos FROM (
         SELECT session_id, 'reserve' AS kind, call_id, 2 * event_id AS seq, epoch_us(ts) AS t, input_bytes, false AS ok, 0 AS tin, 0 AS tout, 0 AS nano FROM v_paired
         UNION ALL
         SELECT session_id, 'settle', call_id, 2 * event_id + 1, epoch_us(ts) + raw_output * 200000000, 0, ok, CASE WHEN ok THEN raw_input ELSE 0 END,
           CASE WHEN ok THEN raw_output ELSE 0 END, CAST(round(coalesce(estimated_usd, 0) * 1000000000) AS BIGINT) FROM v_paired)""",
)
view("v_paired", "SELECT *, 'c' || (event_id - CASE WHEN raw_cached % 10 = 9 THEN 1 ELSE 0 END) AS call_id FROM v_calls")
view(
    "v_budget_runs",
    """SELECT session_id, pos, kind, seq, call_id,
         CASE WHEN kind = 'settle' THEN 'settled_or_missing' WHEN input_bytes > 1000 THEN 'request_bytes' END AS reason,
         CASE WHEN kind = 'reserve' AND input_bytes <= 1000 THEN [call_id] ELSE CAST([] AS VARCHAR[]) END AS known_ids,
         CASE WHEN kind = 'reserve' AND input_bytes <= 1000 THEN [call_id] ELSE CAST([] AS VARCHAR[]) END AS open_ids,
         CASE WHEN kind = 'reserve' AND input_bytes <= 1000 THEN 1 ELSE 0 END AS unknown,
         CAST(0 AS HUGEINT) AS tin, CAST(0 AS HUGEINT) AS tout, CAST(0 AS HUGEINT) AS nano FROM v_budget_events WHERE pos = 1
       UNION ALL SELECT session_id, pos, kind, seq, call_id, reason,
         CASE WHEN kind = 'reserve' AND reason IS NULL THEN list_append(known_ids, call_id) ELSE known_ids END,
         CASE WHEN reason IS NOT NULL THEN open_ids WHEN kind = 'reserve' THEN list_append(open_ids, call_id)
           ELSE list_filter(open_ids, lambda x: x <> call_id) END,
         unknown + CASE WHEN reason IS NOT NULL THEN 0 WHEN kind = 'reserve' THEN 1 WHEN ok THEN -1 ELSE 0 END,
         tin + CASE WHEN reason IS NULL AND kind = 'settle' THEN e_tin ELSE 0 END, tout + CASE WHEN reason IS NULL AND kind = 'settle' THEN e_tout ELSE 0 END,
         nano + CASE WHEN reason IS NULL AND kind = 'settle' THEN e_nano ELSE 0 END FROM (
         SELECT e.session_id, e.pos, e.kind, e.seq, e.call_id, e.ok, e.tin AS e_tin, e.tout AS e_tout, e.nano AS e_nano, r.known_ids, r.open_ids, r.unknown, r.tin, r.tout, r.nano,
           CASE WHEN e.kind = 'settle' THEN CASE WHEN NOT list_contains(r.open_ids, e.call_id) THEN 'settled_or_missing' END
             WHEN list_contains(r.known_ids, e.call_id) THEN 'duplicate_invocation' WHEN e.input_bytes > 1000 THEN 'request_bytes'
             WHEN len(r.known_ids) >= 40 THEN 'invocation_limit' WHEN r.unknown > 0 THEN 'unaccounted_invocation'
             WHEN r.tin >= 60000 THEN 'reported_input_token_threshold' WHEN r.tout >= 9000 THEN 'reported_output_token_threshold'
             WHEN r.nano >= 900000000 THEN 'estimated_cost_threshold' END AS reason
         FROM v_budget_runs r JOIN v_budget_events e ON e.session_id = r.session_id AND e.pos = r.pos + 1)""",
    recursive=True,
)


def budget_events(calls):
    """Each call as two events: its reservation, and later its settlement with the usage.

    Some calls name their predecessor's id, so that reservations and settlements
    also come twice or without a partner.
    """
    known = F.col("usage").isNotNull() & F.col("estimated_usd").isNotNull()
    call = F.concat(F.lit("c"), (F.col("event_id") - F.when(F.col("raw_cached") % 10 == 9, 1).otherwise(0)).cast("string"))
    at = numbers.wall_micros(F.col("ts"))
    zero = F.lit(0).cast("long")
    nano = F.round(F.coalesce("estimated_usd", F.lit(0.0)) * 1_000_000_000).cast("long")
    halves = F.array(
        F.struct(
            F.lit("reserve").alias("kind"), (F.col("event_id") * 2).alias("seq"), at.alias("ts_us"), "input_bytes",
            F.lit(False).alias("known"), zero.alias("tokens_in"), zero.alias("tokens_out"), zero.alias("nano_usd"),
        ),
        F.struct(
            F.lit("settle").alias("kind"), (F.col("event_id") * 2 + 1).alias("seq"),
            (at + F.col("raw_output") * 200_000_000).alias("ts_us"), zero.alias("input_bytes"), known.alias("known"),
            F.coalesce("usage.input_tokens", zero).alias("tokens_in"), F.coalesce("usage.output_tokens", zero).alias("tokens_out"),
            nano.alias("nano_usd"),
        ),
    )
    return calls.select(F.col("session_id").alias("key"), call.alias("call_id"), F.inline(halves))


@query("budget_stream", "SELECT session_id, seq, kind, call_id, reason FROM v_budget_runs")
def budget_stream(spark, folder):
    rows = budget_events(suite_data.as_calls(stream_events(spark, folder)))
    done = jobs.run_available(jobs.budget_stream(rows, qs.LIMITS), "append")
    return done.select(F.col("key").alias("session_id"), "seq", "kind", "call_id", "reason")


view(
    "v_stream_progress",
    """SELECT session_id, event_id, pos + 1 AS revision,
         CAST(sum(gained) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS visible, total
       FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pos,
               greatest(0, coalesce(reach, 0) - coalesce(max(coalesce(reach, 0)) OVER (PARTITION BY session_id, spine_index ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gained
             FROM (SELECT f.*, t.total, CASE WHEN f.event_type IN ('view', 'click') AND f.ord IS NOT NULL THEN p.chars_before + least(f.char_offset, p.n_chars) END AS reach
                   FROM (SELECT session_id, user_id, event_id, ts, event_type, spine_index, ord, char_offset FROM v_located WHERE error IS NULL
                         UNION ALL SELECT session_id, user_id, event_id, ts, event_type, spine_index, ord, char_offset FROM v_events WHERE NOT is_location) f
                   LEFT JOIN (SELECT spine_index, ord, n_chars, sum(n_chars) OVER (PARTITION BY spine_index ORDER BY ord) - n_chars AS chars_before FROM v_blocks) p USING (spine_index, ord)
                   LEFT JOIN (SELECT book_id, sum(n_chars) AS total FROM v_blocks GROUP BY 1) t ON t.book_id = 'src' || (f.user_id % 20)))""",
)


@query(
    "session_progress_stream",
    """SELECT session_id, event_id, revision, visible, CASE WHEN total > 0 THEN CAST(least(10000, visible * 10000 // total) AS BIGINT) ELSE 0 END AS progress_basis_points
       FROM v_stream_progress""",
)
def session_progress_stream(spark, folder):
    blocks = durable(base.blocks(spark, folder).select("book_id", "spine_index", "ord", "block_id", "n_chars"))
    feed = reader.patches(spark, folder, stream_events(spark, folder), ["event_type"], blocks).where("error is null").select(
        "session_id", "book_id", F.col("event_id").alias("seq"), numbers.wall_micros(F.col("ts")).alias("ts_us"), "spine_index", "ord",
        "char_offset", (F.col("event_type").isin("view", "click") & F.col("ord").isNotNull()).alias("is_read"),
    )
    done = jobs.run_available(jobs.session_progress_stream(feed, blocks), "append")
    return done.select("session_id", F.col("seq").alias("event_id"), "revision", "visible", "progress_basis_points")


view(
    "v_job_events",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, 'key' || (k % 2) AS wanted,
         CASE event_type WHEN 'view' THEN 'request' WHEN 'signup' THEN 'request' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'ready' ELSE 'failed' END AS kind FROM v_events""",
)
view(
    "v_jobs",
    """SELECT user_id, event_id, pos, CASE WHEN kind = 'request' THEN 'queued' END AS decision, CASE WHEN kind = 'request' THEN 'queued' END AS state, CASE WHEN kind = 'request' THEN wanted END AS owner
       FROM v_job_events WHERE pos = 1
       UNION ALL SELECT user_id, event_id, pos, decision, CASE WHEN decision = 'queued' THEN 'queued' WHEN kind <> 'request' AND state IS NOT NULL THEN kind ELSE state END,
         CASE WHEN decision = 'queued' THEN wanted ELSE owner END FROM (
         SELECT e.user_id, e.event_id, e.pos, e.kind, e.wanted, j.state, j.owner, CASE WHEN e.kind <> 'request' THEN NULL
             WHEN j.state IN ('queued', 'processing') AND j.owner <> e.wanted THEN 'conflict'
             WHEN j.state IS NOT NULL AND j.state <> 'failed' AND j.owner = e.wanted THEN 'joined' ELSE 'queued' END AS decision
         FROM v_jobs j JOIN v_job_events e ON e.user_id = j.user_id AND e.pos = j.pos + 1)""",
    recursive=True,
)


@query("job_state_stream", "SELECT user_id, event_id, decision, state FROM v_jobs")
def job_state_stream(spark, folder):
    ev = stream_events(spark, folder).withColumn("at", F.timestamp_micros(numbers.wall_micros(F.col("ts"))))
    once = jobs.deduplicated(ev, ["event_id"], "at", "40 days")
    kinds = F.create_map(
        *[F.lit(x) for x in ("view", "request", "signup", "request", "click", "processing", "purchase", "ready", "error", "failed")]
    )
    rows = once.select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        numbers.wall_micros(F.col("ts")).alias("ts_us"),
        kinds[F.col("event_type")].alias("kind"),
        F.concat(F.lit("key"), (F.col("k") % 2).cast("string")).alias("analysis_key"),
        "at",
    )
    done = jobs.run_available(jobs.job_state_stream(rows, keep_seconds=90 * 86_400), "append")
    return done.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "decision", "state")


def _annotations(spark, folder):
    blocks = base.blocks(spark, folder)
    known = base.table(spark, folder, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id")).distinct()
    return jobs.annotation_tables(qr.as_highlights(stream_events(spark, folder), blocks), blocks, known)


view(
    "v_annotations",
    """SELECT event_id, h.session_id, h.text, CASE WHEN b.block_id IS NULL THEN 'block_outside_chapter' WHEN h.start_char >= h.end_char OR h.end_char > b.n_chars THEN 'invalid_range'
         WHEN substring(b.text, h.start_char + 1, h.end_char - h.start_char) <> h.text THEN 'text_mismatch' END AS error
       FROM v_highlights h LEFT JOIN v_blocks b ON b.spine_index = h.spine_index AND b.block_id = h.block_id""",
)


@query("annotation_stream", "SELECT event_id, error FROM v_annotations")
def annotation_stream(spark, folder):
    """Both tables together."""
    accepted, rejected = _annotations(spark, folder)
    return accepted.select("event_id", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("event_id", "error"))


@query("annotation_accepted", "SELECT event_id, session_id, text FROM v_annotations WHERE error IS NULL")
def annotation_accepted(spark, folder):
    """The table of accepted highlights."""
    return _annotations(spark, folder)[0].select("event_id", "session_id", "text")


@query("annotation_rejects", "SELECT event_id, session_id, error FROM v_annotations WHERE error IS NOT NULL")
def annotation_rejects(spark, folder):
    """Its side table: what was turned away, and why."""
    return _annotations(spark, folder)[1].select("event_id", "session_id", "error")
