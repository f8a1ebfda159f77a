"""Reading progress, boundaries and retrieval within them."""

from pyspark.sql import functions as F

from lectern.operators import actions, reading
from lectern.plans import base, reader
from lectern.plans.base import sql_terms
from lectern.plans.registry import query, view
from lectern.session import durable


@query(
    "location_keys",
    """SELECT event_id, spine_index, CASE WHEN error IS NULL THEN coalesce(ord, 0) END AS key_order,
              CASE WHEN error IS NULL THEN coalesce(char_offset, 0) END AS key_offset, error FROM v_located""",
)
def location_keys(spark, folder):
    return reader.located(spark, folder).select(
        "event_id",
        "spine_index",
        F.col("location_key.ord").alias("key_order"),
        F.col("location_key.char_offset").alias("key_offset"),
        "error",
    )


@query("session_coverage", "SELECT session_id, spine_index, end_ord, end_offset FROM v_coverage")
def session_coverage(spark, folder):
    return reader.coverage(spark, folder).drop("book_id")


@query("visible_chars", "SELECT session_id, spine_index, ord, block_id, visible FROM v_reading")
def visible_chars(spark, folder):
    return reading.visible_chars(base.blocks(spark, folder), reader.coverage(spark, folder)).select(
        "session_id", "spine_index", "ord", "block_id", "visible"
    )


@query("completed_chapters", "SELECT session_id, book_id, spine_index, visible, completed FROM v_covered")
def completed_chapters(spark, folder):
    return reading.covered_chapters(base.blocks(spark, folder), reader.coverage(spark, folder))


view(
    "v_progress",
    """SELECT session_id, book_id, coalesce(s.visible, 0) AS visible, coalesce(s.completed_chapters, 0) AS completed_chapters,
         coalesce(least(10000, coalesce(s.visible, 0) * 10000 // t.total), 0) AS progress_basis_points
       FROM v_sessions
       LEFT JOIN (SELECT session_id, CAST(sum(visible) AS BIGINT) AS visible,
                    count(*) FILTER (completed) AS completed_chapters FROM v_covered GROUP BY ALL) s USING (session_id)
       LEFT JOIN (SELECT book_id, CAST(sum(n_chars) AS BIGINT) AS total FROM v_blocks GROUP BY ALL) t USING (book_id)""",
)


def progress(spark, folder):
    blocks = base.blocks(spark, folder)
    covered = reading.covered_chapters(blocks, reader.coverage(spark, folder))
    return reading.reading_progress(reader.sessions(spark, folder), covered, reading.book_chars(blocks))


@query(
    "reading_progress",
    "SELECT session_id, book_id, visible, completed_chapters, progress_basis_points FROM v_progress",
)
def reading_progress(spark, folder):
    return progress(spark, folder)


@query(
    "session_state",
    """SELECT session_id, arg_max(spine_index, (ts, event_id)) FILTER (is_location) AS spine_index,
         arg_max_null(ord, (ts, event_id)) FILTER (is_location) AS ord,
         arg_max(char_offset, (ts, event_id)) FILTER (is_location) AS char_offset,
         arg_max(mode, (ts, event_id)) FILTER (mode IS NOT NULL) AS mode, count(*) + 1 AS revision
       FROM (SELECT session_id, ts, event_id, spine_index, ord, char_offset, mode, is_location FROM v_located WHERE error IS NULL
             UNION ALL SELECT session_id, ts, event_id, spine_index, ord, char_offset, mode, is_location FROM v_events WHERE NOT is_location)
       GROUP BY session_id""",
)
def session_state(spark, folder):
    return reading.session_state(reader.patches(spark, folder))


@query(
    "excluded_chapters",
    """SELECT session_id, book_id, c.spine_index FROM (SELECT session_id, book_id FROM v_sessions) s
       JOIN v_chapters c USING (book_id)
       WHERE NOT is_noise AND NOT EXISTS (SELECT 1 FROM v_coverage v
         WHERE v.session_id = s.session_id AND v.spine_index = c.spine_index)""",
)
def excluded_chapters(spark, folder):
    return reading.excluded_chapters(
        reader.sessions(spark, folder).drop("spine_index"), base.chapters(spark, folder), reader.coverage(spark, folder)
    )


view(
    "v_boundaries",
    """SELECT r.*, s.book_id, s.spine_index AS current_spine,
         CASE WHEN s.session_id IS NULL THEN NULL WHEN spoiler_mode = 'read_range' THEN 's:' || r.session_id
              WHEN spoiler_mode = 'current_chapter' THEN 'c:' || s.book_id || ':' || s.spine_index ELSE 'b:' || s.book_id END AS scope_id,
         CASE WHEN s.session_id IS NULL THEN NULL WHEN spoiler_mode = 'read_range' THEN coalesce(k.covered, 0)
              WHEN spoiler_mode = 'current_chapter' THEN coalesce(h.here, 0) ELSE coalesce(z.filled, 0) END AS allowed_chapters,
         z.content, CASE WHEN s.session_id IS NULL THEN 'unknown_session' END AS error
       FROM v_requests r LEFT JOIN v_sessions s USING (session_id)
       LEFT JOIN (SELECT session_id, count(*) AS covered FROM v_coverage GROUP BY ALL) k USING (session_id)
       LEFT JOIN (SELECT DISTINCT spine_index, 1 AS here FROM v_blocks) h ON h.spine_index = s.spine_index
       LEFT JOIN (SELECT book_id, count(*) AS content, count(f.spine_index) AS filled FROM v_chapters c
                  LEFT JOIN (SELECT DISTINCT spine_index FROM v_blocks) f USING (spine_index)
                  WHERE NOT is_noise GROUP BY ALL) z ON z.book_id = s.book_id""",
)


@query(
    "spoiler_boundary",
    """SELECT request_id, spoiler_mode, scope_id, CAST(allowed_chapters AS BIGINT) AS allowed_chapters,
         CAST(content - allowed_chapters AS BIGINT) AS excluded_chapters, error FROM v_boundaries""",
)
def spoiler_boundary(spark, folder):
    return reader.boundaries(spark, folder).select(
        "request_id", "spoiler_mode", "scope_id", "allowed_chapters", "excluded_chapters", "error"
    )


view(
    "v_candidates",
    """SELECT 's:' || session_id AS scope_id, spine_index, ord, block_id, fp, visible, substring(text, 1, CAST(visible AS BIGINT)) AS text
       FROM v_reading WHERE visible > 0 AND 's:' || session_id IN (SELECT scope_id FROM v_boundaries WHERE error IS NULL)
       UNION ALL SELECT 'c:' || book_id || ':' || spine_index, spine_index, ord, block_id, fp, n_chars, text FROM v_blocks
       WHERE 'c:' || book_id || ':' || spine_index IN (SELECT scope_id FROM v_boundaries WHERE error IS NULL)
       UNION ALL SELECT 'b:' || book_id, spine_index, ord, block_id, fp, n_chars, text FROM v_blocks
       WHERE 'b:' || book_id IN (SELECT scope_id FROM v_boundaries WHERE error IS NULL)""",
)
view(
    "v_scope_terms",
    f"SELECT scope_id, spine_index, ord, block_id, strlen(text) AS bytes, visible, fp, unnest({sql_terms('text')}) AS term FROM v_candidates",
)
view(
    "v_request_terms",
    f"SELECT scope_id, request_id, unnest({sql_terms('question')}) AS term FROM v_boundaries WHERE error IS NULL",
)
view(
    "v_ranked",
    """SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, spine_index, ord) AS rank FROM (
         SELECT request_id, scope_id, spine_index, ord, block_id, bytes, visible, fp, CAST(sum(100000 // (df + 1)) AS BIGINT) AS score
         FROM v_scope_terms JOIN v_request_terms USING (scope_id, term)
         JOIN (SELECT scope_id, term, count(*) AS df FROM v_scope_terms GROUP BY ALL) USING (scope_id, term)
         GROUP BY ALL) WHERE score > 0""",
)


def ranked_requests(spark, folder, **options):
    cover = reader.coverage(spark, folder)
    bounds = reader.boundaries(spark, folder, cover)
    cand = reading.scope_candidates(bounds, cover, base.blocks(spark, folder))
    return reading.retrieve(bounds, cand, **options)


@query(
    "retrieve",
    "SELECT request_id, rank, spine_index, ord, block_id, score, visible FROM v_ranked WHERE rank <= 8",
)
def retrieve(spark, folder):
    return ranked_requests(spark, folder).select(
        "request_id", "rank", "spine_index", "ord", "block_id", "score", "visible"
    )


def _greedy(table: str, start: int) -> str:
    return f"""SELECT request_id, rank, bytes + 256 <= {start} AS taken,
         CASE WHEN bytes + 256 <= {start} THEN {start} - bytes - 256 ELSE {start} END AS remaining,
         CASE WHEN bytes + 256 <= {start} THEN 1 ELSE 0 END AS picked FROM v_ranked WHERE rank = 1
       UNION ALL
       SELECT r.request_id, r.rank, g.picked < 8 AND r.bytes + 256 <= g.remaining,
         CASE WHEN g.picked < 8 AND r.bytes + 256 <= g.remaining THEN g.remaining - r.bytes - 256 ELSE g.remaining END,
         CASE WHEN g.picked < 8 AND r.bytes + 256 <= g.remaining THEN g.picked + 1 ELSE g.picked END
       FROM {table} g JOIN v_ranked r ON r.request_id = g.request_id AND r.rank = g.rank + 1 WHERE g.picked < 8"""


view("v_greedy", _greedy("v_greedy", 1500), recursive=True)


@query("byte_budget_select", "SELECT request_id, r.rank, block_id FROM v_greedy JOIN v_ranked r USING (request_id, rank) WHERE taken")
def byte_budget_select(spark, folder):
    """A context of 3000 bytes leaves 1500, so blocks are skipped for real."""
    return ranked_requests(spark, folder, context_limit=3000).select("request_id", "rank", "block_id")


view(
    "v_evidence",
    """SELECT v.request_id, string_agg(c.text, chr(10) || chr(10) ORDER BY v.rank) AS joined, count(*) AS n_refs
       FROM v_ranked v JOIN v_candidates c ON c.scope_id = v.scope_id AND c.block_id = v.block_id
       WHERE rank <= 8 GROUP BY v.request_id""",
)


@query(
    "answer_requests",
    f"""SELECT request_id, coalesce(n_refs, 0) AS n_refs, n_refs IS NULL AS insufficient_evidence,
         CASE WHEN n_refs IS NULL THEN '{actions.TITLE_INSUFFICIENT}' ELSE '{actions.TITLE_EVIDENCE}' END AS title,
         sha256(CASE WHEN n_refs IS NULL THEN '{actions.ANSWER_INSUFFICIENT}'
           ELSE '{actions.ANSWER_EVIDENCE}' || chr(10) || joined END) AS answer_hash,
         CASE WHEN n_refs IS NULL THEN 'inferred' ELSE 'grounded' END AS grounding,
         CAST(0 AS BIGINT) AS confidence_basis_points,
         CASE WHEN spoiler_mode = 'full_book' THEN 'full_book_allowed' ELSE 'within_boundary' END AS spoiler_status
       FROM v_boundaries LEFT JOIN v_evidence USING (request_id) WHERE error IS NULL""",
)
def answer_requests(spark, folder):
    cover = reader.coverage(spark, folder)
    bounds = reader.boundaries(spark, folder, cover)
    cand = reading.scope_candidates(bounds, cover, base.blocks(spark, folder))
    cards = actions.answer_requests(bounds, cand, *reading.retrieve_matched(bounds, cand))
    return cards.select(
        "request_id",
        F.size("source_refs").cast("long").alias("n_refs"),
        "insufficient_evidence",
        "title",
        F.sha2("answer", 256).alias("answer_hash"),
        "grounding",
        "confidence_basis_points",
        "spoiler_status",
    )


@query(
    "answer_outcomes",
    """SELECT b.request_id, CASE WHEN m.request_id IS NOT NULL AND NOT m.fits THEN 'context_too_large' END AS error, m.request_id IS NULL AS unmatched
       FROM v_boundaries b LEFT JOIN (SELECT request_id, bool_or(bytes + 256 <= 400) AS fits FROM v_ranked GROUP BY ALL) m USING (request_id) WHERE b.error IS NULL""",
)
def answer_outcomes(spark, folder):
    """With a context of 800 bytes, matches of many requests do not fit: that is an error, not a lack of evidence."""
    cover = reader.coverage(spark, folder)
    bounds = reader.boundaries(spark, folder, cover)
    cand = reading.scope_candidates(bounds, cover, base.blocks(spark, folder))
    cards = actions.answer_requests(bounds, cand, *reading.retrieve_matched(bounds, cand, context_limit=800))
    return cards.select("request_id", "error", F.coalesce("insufficient_evidence", F.lit(False)).alias("unmatched"))


@query(
    "evidence_refs",
    """SELECT request_id, block_id, CAST(0 AS BIGINT) AS start_char, visible AS end_char, fp AS text_fingerprint
       FROM v_ranked WHERE rank <= 8""",
)
def evidence_refs(spark, folder):
    return actions.evidence_refs(ranked_requests(spark, folder))


view(
    "v_selection",
    """SELECT session_id, arg_max(spine_index, (ts, event_id)) AS spine_index,
         arg_max_null(block_id, (ts, event_id)) AS block_id FROM v_located WHERE error IS NULL GROUP BY session_id""",
)


def selections(spark, folder, blocks=None):
    """The block (or only the chapter) each session looked at last."""
    last = F.max_by(F.struct("book_id", "spine_index", "block_id"), F.struct("ts", "event_id"))
    ok = reader.located(spark, folder, blocks).where("error is null")
    return ok.groupBy("session_id").agg(last.alias("at")).select(
        F.col("session_id").alias("request_id"), "at.book_id", "at.spine_index", "at.block_id"
    )


@query(
    "nearby_blocks",
    """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY spine_index ORDER BY ord) AS pos FROM v_blocks)
       SELECT s.session_id AS request_id, p.spine_index, p.block_id FROM v_selection s
       JOIN placed a ON a.spine_index = s.spine_index AND a.block_id = s.block_id
       JOIN placed p ON p.spine_index = s.spine_index AND p.pos BETWEEN a.pos - 1 AND a.pos + 1
       UNION ALL SELECT s.session_id, p.spine_index, p.block_id FROM v_selection s
       JOIN placed p USING (spine_index) WHERE s.block_id IS NULL AND p.pos <= 3""",
)
def nearby_blocks(spark, folder):
    return reading.nearby_blocks(selections(spark, folder), base.blocks(spark, folder)).select(
        "request_id", "spine_index", "block_id"
    )


view(
    "v_connect",
    """SELECT s.session_id AS request_id, s.spine_index AS before, substring(b.text, 1, 60) AS question FROM v_selection s
       JOIN v_blocks b ON b.spine_index = s.spine_index AND b.block_id = s.block_id""",
)
view(
    "v_connect_terms",
    f"""SELECT request_id, spine_index, ord, block_id, unnest({sql_terms('text')}) AS term FROM (
         SELECT q.request_id, r.spine_index, r.ord, r.block_id, substring(r.text, 1, CAST(r.visible AS BIGINT)) AS text
         FROM v_connect q JOIN v_reading r ON r.session_id = q.request_id AND r.visible > 0 AND r.spine_index < q.before)""",
)
view("v_connect_asked", f"SELECT request_id, unnest({sql_terms('question')}) AS term FROM v_connect")


@query(
    "connect_requests",
    """SELECT request_id, block_id, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, spine_index, ord) AS rank FROM (
           SELECT t.request_id, t.spine_index, t.ord, t.block_id, CAST(sum(100000 // (d.df + 1)) AS BIGINT) AS score
           FROM v_connect_terms t JOIN v_connect_asked a USING (request_id, term)
           JOIN (SELECT request_id, term, count(*) AS df FROM v_connect_terms GROUP BY ALL) d USING (request_id, term) GROUP BY ALL) WHERE score > 0)
       WHERE rank <= 8""",
)
def connect_requests(spark, folder):
    """What the selected passage connects to in earlier chapters that the reader has read."""
    blocks, cover = base.blocks(spark, folder), reader.coverage(spark, folder)
    spot = blocks.select("book_id", "spine_index", "block_id", "text")
    asked = selections(spark, folder).join(spot, ["book_id", "spine_index", "block_id"]).select(
        "request_id", F.col("request_id").alias("session_id"), F.substring("text", 1, 60).alias("question"),
        F.lit("read_range").alias("spoiler_mode"), F.col("spine_index").alias("before"),
    )
    bounds = durable(
        reading.spoiler_boundary(durable(asked), reader.sessions(spark, folder), cover, base.chapters(spark, folder), blocks)
    )
    return reading.retrieve(bounds, reading.scope_candidates(bounds, cover, blocks)).select("request_id", "block_id", "rank")


view(
    "v_highlights",
    """SELECT e.event_id, e.session_id, e.spine_index, coalesce(b.block_id, 'none') AS block_id, k AS start_char,
         k + e.event_id % 40 AS end_char,
         CASE WHEN e.event_id % 5 = 0 THEN 'x' ELSE substring(b.text, k + 1, e.event_id % 40) END AS text
       FROM v_events e LEFT JOIN v_blocks b ON b.spine_index = e.spine_index AND b.ord = e.event_id % 8""",
)


def highlights(spark, folder):
    """Every event marks a stretch of the block it names; some of them badly."""
    return as_highlights(reader.events(spark, folder), base.blocks(spark, folder))


def as_highlights(events, blocks):
    spot = blocks.select("book_id", "spine_index", F.col("ord").alias("_ord"), "block_id", F.col("text").alias("_t"))
    ev = events.withColumn("_ord", F.col("event_id") % 8)
    return ev.join(spot, ["book_id", "spine_index", "_ord"], "left").select(
        "event_id",
        "session_id",
        "book_id",
        "spine_index",
        F.coalesce("block_id", F.lit("none")).alias("block_id"),
        F.col("k").alias("start_char"),
        (F.col("k") + F.col("event_id") % 40).alias("end_char"),
        F.when(F.col("event_id") % 5 == 0, "x")
        .otherwise(F.expr("substring(_t, cast(k + 1 as int), cast(event_id % 40 as int))"))
        .alias("text"),
    )


@query(
    "validate_highlights",
    """SELECT event_id, CASE WHEN b.block_id IS NULL THEN 'block_outside_chapter'
         WHEN h.start_char >= h.end_char OR h.end_char > b.n_chars THEN 'invalid_range'
         WHEN substring(b.text, h.start_char + 1, h.end_char - h.start_char) <> h.text THEN 'text_mismatch'
         WHEN s.session_id IS NULL THEN 'unknown_session' END AS error
       FROM v_highlights h LEFT JOIN v_blocks b ON b.spine_index = h.spine_index AND b.block_id = h.block_id
       LEFT JOIN v_sessions s ON s.session_id = h.session_id""",
)
def validate_highlights(spark, folder):
    return reading.validate_highlights(
        highlights(spark, folder), base.blocks(spark, folder), reader.sessions(spark, folder)
    ).select("event_id", "error")


def notes(spark, folder):
    """One note per conversation turn of a reader, some without text or block."""
    turns = base.table(spark, folder, "conversations")
    at = base.blocks(spark, folder).where("ord = 0").select(F.col("spine_index").alias("conv_id"), "block_id")
    return turns.join(at, "conv_id", "left").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("note_id"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("session_id"),
        F.format_string("src%d", F.col("conv_id") % 20).alias("book_id"),
        (F.col("conv_id") + 20 * F.col("turn")).alias("spine_index"),
        F.when(F.col("turn") == 3, F.lit("gone")).otherwise(F.col("block_id")).alias("block_id"),
        F.when(F.col("role") == "system", " \t").otherwise(F.col("text")).alias("text"),
    )


view(
    "v_notes",
    """SELECT conv_id || '-' || turn AS note_id, 'u' || conv_id AS session_id, 'src' || (conv_id % 20) AS book_id,
         conv_id + 20 * turn AS spine_index, CASE WHEN turn = 3 THEN 'gone' ELSE b.block_id END AS block_id,
         CASE WHEN role = 'system' THEN ' ' || chr(9) ELSE c.text END AS text
       FROM conversations c LEFT JOIN v_blocks b ON b.spine_index = c.conv_id AND b.ord = 0""",
)
view(
    "v_checked_notes",
    f"""SELECT n.*, CASE WHEN c.spine_index IS NULL THEN 'unknown_chapter' WHEN {base.sql_norm('n.text')} = '' THEN 'blank_text'
         WHEN n.block_id IS NOT NULL AND b.block_id IS NULL THEN 'unknown_block'
         WHEN s.session_id IS NULL THEN 'unknown_session' END AS error
       FROM v_notes n LEFT JOIN v_chapters c ON c.book_id = n.book_id AND c.spine_index = n.spine_index
       LEFT JOIN v_blocks b ON b.book_id = n.book_id AND b.block_id = n.block_id
       LEFT JOIN v_sessions s ON s.session_id = n.session_id""",
)


def checked_notes(spark, folder):
    return reading.validate_notes(
        notes(spark, folder), base.chapters(spark, folder), base.blocks(spark, folder), reader.sessions(spark, folder)
    )


@query("validate_notes", "SELECT note_id, error FROM v_checked_notes")
def validate_notes(spark, folder):
    return checked_notes(spark, folder).select("note_id", "error")


@query(
    "state_matches_session",
    """SELECT r.request_id, CASE WHEN p.session_id IS NULL THEN 'unknown_session'
         WHEN r.n % 4 = 0 OR p.progress_basis_points <> p.progress_basis_points + (r.n % 3) THEN 'state_mismatch' END AS error
       FROM (SELECT *, length(question) AS n FROM v_requests) r LEFT JOIN v_progress p USING (session_id)""",
)
def state_matches_session(spark, folder):
    """A submitted state drifts from the stored one with the length of the question."""
    stored = progress(spark, folder).join(reader.sessions(spark, folder).drop("book_id"), "session_id").select(
        "session_id",
        "spine_index",
        F.lit(0).cast("long").alias("ord"),
        F.lit(None).cast("long").alias("char_offset"),
        "progress_basis_points",
    )
    n = F.char_length("question")
    submitted = reader.requests(spark, folder).join(stored, "session_id", "left").select(
        "request_id",
        "session_id",
        "spine_index",
        F.when(n % 4 == 0, 1).otherwise(F.col("ord")).cast("long").alias("ord"),
        "char_offset",
        (F.col("progress_basis_points") + n % 3).alias("progress_basis_points"),
    )
    return reading.state_matches_session(submitted, stored).select("request_id", "error")


@query(
    "review_evidence_limits",
    """SELECT session_id, spine_index, block_id, visible AS end_char FROM v_reading
       JOIN v_coverage USING (session_id, spine_index) WHERE ord <= end_ord""",
)
def review_evidence_limits(spark, folder):
    return reading.unread_limits(base.blocks(spark, folder), reader.coverage(spark, folder)).drop("book_id")
