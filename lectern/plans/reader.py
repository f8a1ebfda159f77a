"""The event feed seen as reader sessions.

user = session, and the location an event reports is a block of the session's
book.  ``view`` and ``click`` confirm reading, ``purchase`` only moves the
current location, ``signup`` reports a chapter without a block, ``error``
changes the spoiler mode.
"""

from pyspark.sql import functions as F

from lectern.plans import base
from lectern.plans.registry import view
from lectern.session import durable


def events(spark, folder):
    return mapped(base.table(spark, folder, "events"))


def mapped(raw):
    """Reader columns of event rows, batch or stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    return raw.select(
        "event_id",
        "ts",
        "user_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.format_string("src%d", F.col("user_id") % 20).alias("book_id"),
        "event_type",
        "value",
        k.alias("k"),
        (F.col("user_id") % 20 + 20 * (k % 10)).alias("spine_index"),
        F.when(F.col("event_type") != "signup", F.col("event_id") % 8).alias("ord"),
        (k * 3).alias("char_offset"),
        F.col("event_type").isin("view", "click", "purchase", "signup").alias("is_location"),
        F.when(
            F.col("event_type") == "error",
            F.element_at(F.array(F.lit("read_range"), F.lit("current_chapter"), F.lit("full_book")), (k % 3 + 1).cast("int")),
        ).alias("mode"),
    )


view(
    "v_events",
    """SELECT *, user_id % 20 + 20 * (k % 10) AS spine_index,
         CASE WHEN event_type <> 'signup' THEN event_id % 8 END AS ord, k * 3 AS char_offset,
         event_type IN ('view', 'click', 'purchase', 'signup') AS is_location,
         CASE WHEN event_type = 'error' THEN ['read_range', 'current_chapter', 'full_book'][k % 3 + 1] END AS mode
       FROM (SELECT event_id, ts, user_id, 'u' || user_id AS session_id, event_type, "value",
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
view(
    "v_located",
    """SELECT e.*, b.block_id, b.n_chars,
         CASE WHEN c.spine_index IS NULL THEN 'unknown_chapter'
              WHEN e.ord IS NOT NULL AND b.block_id IS NULL THEN 'invalid_block'
              WHEN e.ord IS NOT NULL AND e.char_offset > b.n_chars THEN 'invalid_offset' END AS error
       FROM v_events e LEFT JOIN v_chapters c USING (spine_index) LEFT JOIN v_blocks b
         ON b.spine_index = e.spine_index AND b.ord = e.ord WHERE is_location""",
)


def located(spark, folder, blocks=None):
    """Location events with their error; a query that has stored the blocks gives them."""
    from lectern.operators import reading

    blocks = base.blocks(spark, folder) if blocks is None else blocks
    return reading.location_keys(events(spark, folder).where("is_location"), base.chapters(spark, folder), blocks)


# Reading patches that the session accepts.
view(
    "v_patches",
    """SELECT * FROM v_located WHERE error IS NULL AND event_type IN ('view', 'click') AND ord IS NOT NULL""",
)
view(
    "v_coverage",
    """SELECT session_id, spine_index, m // 1000000 AS end_ord, m % 1000000 AS end_offset FROM (
         SELECT session_id, spine_index, max(ord * 1000000 + char_offset) AS m FROM v_patches GROUP BY ALL)""",
)
view(
    "v_sessions",
    """SELECT session_id, 'src' || book_no AS book_id, spine_index FROM (
         SELECT session_id, user_id % 20 AS book_no,
           arg_max(spine_index, (ts, event_id)) FILTER (is_location AND error IS NULL) AS spine_index
         FROM v_located GROUP BY session_id, user_id)""",
)
view(
    "v_reading",
    """SELECT c.session_id, b.*, CASE WHEN b.ord < c.end_ord THEN b.n_chars
         WHEN b.ord = c.end_ord THEN least(c.end_offset, b.n_chars) ELSE 0 END AS visible
       FROM v_coverage c JOIN v_blocks b USING (spine_index)""",
)
view(
    "v_covered",
    """SELECT session_id, book_id, spine_index, CAST(sum(visible) AS BIGINT) AS visible, bool_and(visible = n_chars) AS completed
       FROM v_reading GROUP BY ALL""",
)
view(
    "v_requests",
    """SELECT conv_id || '-' || turn AS request_id, 'u' || conv_id AS session_id, text AS question,
         ['read_range', 'current_chapter', 'full_book'][(turn // 2) % 3 + 1] AS spoiler_mode
       FROM conversations WHERE role = 'user'""",
)


def coverage(spark, folder, blocks=None):
    from lectern.operators import reading

    accepted = located(spark, folder, blocks).where("error is null and event_type in ('view', 'click')")
    return durable(reading.coverage(accepted))


def sessions(spark, folder, blocks=None):
    """session_id, book_id, current chapter."""
    at = F.struct("ts", "event_id")
    state = located(spark, folder, blocks).groupBy("session_id", "user_id").agg(
        F.max_by("spine_index", F.when(F.col("error").isNull(), at)).alias("spine_index")
    )
    return state.select(
        "session_id", F.format_string("src%d", F.col("user_id") % 20).alias("book_id"), "spine_index"
    )


def patches(spark, folder, rows=None, more=(), blocks=None):
    """Location patches with their error, and mode changes, as one feed for the session state."""
    from lectern.operators import reading

    rows = events(spark, folder) if rows is None else rows
    fields = ["session_id", "event_id", "ts", "book_id", "spine_index", "ord", "char_offset", "mode", "is_location", *more]
    places = blocks
    if places is None:
        places = durable(base.blocks(spark, folder).select("book_id", "spine_index", "ord", "block_id", "n_chars"))
    moved = reading.location_keys(rows.where("is_location"), durable(base.chapters(spark, folder)), places)
    other = rows.where("not is_location").withColumn("error", F.lit(None).cast("string"))
    return moved.select(*fields, "error").unionByName(other.select(*fields, "error"))


def requests(spark, folder):
    turns = base.table(spark, folder, "conversations").where("role = 'user'")
    modes = F.array(F.lit("read_range"), F.lit("current_chapter"), F.lit("full_book"))
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("text").alias("question"),
        F.element_at(modes, F.expr("cast((turn div 2) % 3 + 1 as int)")).alias("spoiler_mode"),
    )


def boundaries(spark, folder, cover=None):
    from lectern.operators import reading

    return durable(
        reading.spoiler_boundary(
            requests(spark, folder),
            sessions(spark, folder),
            coverage(spark, folder) if cover is None else cover,
            base.chapters(spark, folder),
            base.blocks(spark, folder),
        )
    )
