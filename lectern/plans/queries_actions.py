"""Reader-action queries: context, explanation, checkpoints, reflection, card checks."""

from pyspark.sql import functions as F

from lectern.operators import actions, grounding, reading
from lectern.plans import base, package, reader
from lectern.plans import queries_reading as qr
from lectern.plans.registry import query, view
from lectern.session import durable

view(
    "v_needs",
    """SELECT r.book_id, 'concept-' || r.spine_index AS concept_id, b.spine_index, max(b.ord * 1000000 + r.end_char) AS need,
         bool_or(b.block_id IS NULL OR r.end_char > b.n_chars OR r.start_char >= r.end_char OR r.text_fingerprint <> b.fp) AS invalid
       FROM v_ref_rows r LEFT JOIN v_blocks b ON b.block_id = r.block_id WHERE r.kind = 0 GROUP BY ALL""",
)
view(
    "v_related",
    """SELECT request_id, concept_id FROM (
         SELECT s.session_id AS request_id, h.concept_id, bool_and(NOT n.invalid AND coalesce(n.need <= c.end_ord * 1000000 + c.end_offset, false)) AS ok
         FROM v_sessions s JOIN v_needs h ON h.spine_index = s.spine_index JOIN v_needs n ON n.book_id = h.book_id AND n.concept_id = h.concept_id
         LEFT JOIN v_coverage c ON c.session_id = s.session_id AND c.spine_index = n.spine_index GROUP BY ALL) WHERE ok""",
)


def session_requests(spark, folder, blocks=None):
    """One request per reader about the chapter and block it looked at last."""
    return durable(qr.selections(spark, folder, blocks).withColumn("session_id", F.col("request_id")))


def appearances(analyses):
    return package.concepts(analyses).select("book_id", "concept_id", F.explode("appearances").alias("r")).select(
        "book_id", "concept_id", "r.*"
    )


@query("related_concepts", "SELECT request_id, concept_id FROM v_related")
def related_concepts(spark, folder):
    blocks = base.stored_blocks(spark, folder)
    needs = durable(actions.concept_needs(appearances(package.chapter_analyses(spark, folder)), blocks))
    asked = reader.sessions(spark, folder, blocks).select(F.col("session_id").alias("request_id"), "session_id", "book_id", "spine_index")
    return actions.related_concepts(durable(asked), needs, reader.coverage(spark, folder, blocks))


view(
    "v_readable",
    """SELECT s.session_id FROM v_selection s JOIN v_covered v ON v.session_id = s.session_id AND v.spine_index = s.spine_index AND v.completed
       WHERE NOT EXISTS (SELECT 1 FROM v_chapter_cites c LEFT JOIN v_reading r ON r.session_id = s.session_id AND r.block_id = c.block_id
         WHERE c.spine_index = s.spine_index AND (r.block_id IS NULL OR c.end_char > r.visible))""",
)


def _context(spark, folder):
    blocks = base.stored_blocks(spark, folder)
    cover = reader.coverage(spark, folder, blocks)
    analyses = package.stored_analyses(spark, folder)
    asked = session_requests(spark, folder, blocks)
    readable = durable(
        actions.readable_analyses(
            asked,
            analyses,
            grounding.chapter_citations(analyses),
            reading.covered_chapters(blocks, cover),
            reading.visible_chars(blocks, cover),
        )
    )
    return blocks, cover, analyses, asked, readable


view(
    "v_near_text",
    """SELECT s.session_id, b.ord, b.block_id, substring(b.text, 1, CASE WHEN b.ord < c.end_ord THEN b.n_chars WHEN b.ord = c.end_ord THEN least(c.end_offset, b.n_chars) ELSE 0 END) AS text
       FROM v_selection s JOIN v_coverage c ON c.session_id = s.session_id AND c.spine_index = s.spine_index
       JOIN (SELECT *, row_number() OVER (PARTITION BY spine_index ORDER BY ord) AS pos FROM v_blocks) b ON b.spine_index = s.spine_index
       LEFT JOIN (SELECT spine_index, block_id, row_number() OVER (PARTITION BY spine_index ORDER BY ord) AS pos FROM v_blocks) a
         ON a.spine_index = s.spine_index AND a.block_id = s.block_id
       WHERE CASE WHEN s.block_id IS NULL THEN b.pos <= 3 ELSE b.pos BETWEEN a.pos - 1 AND a.pos + 1 END""",
)


view(
    "v_shown_concepts",
    """SELECT r.session_id, string_agg(r.concept_id || '=' || k.name, ',' ORDER BY r.concept_id) AS concepts FROM (
         SELECT session_id, concept_id FROM (
           SELECT s.session_id, h.concept_id, h.book_id, bool_and(NOT n.invalid AND coalesce(n.need <= c.end_ord * 1000000 + c.end_offset, false)) AS ok
           FROM v_selection s JOIN v_needs h ON h.spine_index = s.spine_index JOIN v_needs n ON n.book_id = h.book_id AND n.concept_id = h.concept_id
           LEFT JOIN v_coverage c ON c.session_id = s.session_id AND c.spine_index = n.spine_index GROUP BY ALL) WHERE ok) r
       JOIN v_concepts k USING (concept_id) GROUP BY r.session_id""",
)


def _assembled(spark, folder):
    """The context of every reader's request: clipped blocks, chapter analysis and concepts."""
    blocks, cover, analyses, asked, readable = _context(spark, folder)
    near = reading.nearby_blocks(asked.select("request_id", "book_id", "spine_index", "block_id"), blocks)
    needs = durable(actions.concept_needs(appearances(analyses), blocks))
    related = durable(actions.related_concepts(asked.select("request_id", "session_id", "book_id", "spine_index"), needs, cover))
    return actions.assemble_context(asked, near, cover, readable, analyses, related, package.concepts(analyses))


def _named_concepts():
    named = lambda c: F.concat(c["concept_id"], F.lit("="), F.get_json_object(c["concept"], "$.name"))
    return F.array_join(F.transform("related_concepts", named), ",").alias("concepts")


@query(
    "assemble_context",
    """WITH shown AS (SELECT session_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM v_near_text WHERE text <> '' GROUP BY ALL),
       reach AS (SELECT session_id, count(*) AS n FROM v_coverage GROUP BY ALL)
       SELECT s.session_id AS request_id, t.block_id AS selected_id, length(t.text) AS selected_chars, coalesce(h.n, 0) AS nearby, coalesce(h.chars, 0) AS nearby_chars,
         e.session_id IS NOT NULL AS has_analysis, CASE WHEN e.session_id IS NOT NULL THEN substring(a.joined, 1, 400) END AS deep, CAST(0 AS BIGINT) AS argument_steps,
         CASE WHEN c.session_id IS NOT NULL THEN coalesce(k.concepts, '') ELSE '' END AS concepts, c.session_id IS NOT NULL AS allowed, coalesce(reach.n, 0) AS allowed_chapters
       FROM v_selection s LEFT JOIN v_coverage c ON c.session_id = s.session_id AND c.spine_index = s.spine_index
       LEFT JOIN v_near_text t ON t.session_id = s.session_id AND t.block_id = s.block_id AND t.text <> '' LEFT JOIN shown h ON h.session_id = s.session_id
       LEFT JOIN (SELECT DISTINCT session_id FROM v_readable) e ON e.session_id = s.session_id LEFT JOIN v_analyses a ON a.spine_index = s.spine_index
       LEFT JOIN v_shown_concepts k ON k.session_id = s.session_id LEFT JOIN reach ON reach.session_id = s.session_id""",
)
def assemble_context(spark, folder):
    """What an answer may draw on: selected and nearby blocks as far as read, chapter analysis, concepts of the chapter."""
    made = _assembled(spark, folder)
    chars = F.aggregate("nearby_blocks", F.lit(0).cast("long"), lambda n, b: n + F.char_length(b["text"]))
    return made.select(
        "request_id",
        F.col("selected_block.block_id").alias("selected_id"),
        F.char_length("selected_block.text").cast("long").alias("selected_chars"),
        F.size("nearby_blocks").cast("long").alias("nearby"),
        chars.alias("nearby_chars"),
        F.col("chapter_analysis").isNotNull().alias("has_analysis"),
        F.get_json_object("chapter_analysis", "$.summary.deep").alias("deep"),
        F.size("argument_flow").cast("long").alias("argument_steps"),
        _named_concepts(),
        F.col("error").isNull().alias("allowed"),
        "allowed_chapters",
    )


@query(
    "request_context",
    """WITH near AS (SELECT session_id, string_agg(block_id || ':' || text, chr(10) ORDER BY ord) AS texts, count(*) AS n FROM v_near_text WHERE text <> '' GROUP BY session_id),
       related AS (SELECT s.session_id, string_agg(n.concept_id || '=' || k.name, ',' ORDER BY n.concept_id) AS concepts FROM (
           SELECT request_id AS session_id, concept_id FROM (
             SELECT s.session_id AS request_id, h.concept_id, h.book_id, bool_and(NOT n.invalid AND coalesce(n.need <= c.end_ord * 1000000 + c.end_offset, false)) AS ok
             FROM v_selection s JOIN v_needs h ON h.spine_index = s.spine_index JOIN v_needs n ON n.book_id = h.book_id AND n.concept_id = h.concept_id
             LEFT JOIN v_coverage c ON c.session_id = s.session_id AND c.spine_index = n.spine_index GROUP BY ALL) WHERE ok) n
         JOIN v_selection s USING (session_id) JOIN v_concepts k USING (concept_id) GROUP BY s.session_id),
       reach AS (SELECT session_id, count(*) AS n FROM v_coverage GROUP BY session_id)
       SELECT s.session_id AS request_id, CASE WHEN c.session_id IS NULL THEN 'outside_boundary' END AS error,
         t.block_id AS selected_id, sha256(t.text) AS selected_hash, coalesce(near.n, 0) AS nearby, sha256(near.texts) AS nearby_hash,
         CASE WHEN c.session_id IS NOT NULL AND s.session_id IN (SELECT session_id FROM v_readable) THEN substring(a.joined, 1, 400) END AS deep,
         CASE WHEN c.session_id IS NOT NULL THEN coalesce(r.concepts, '') ELSE '' END AS concepts, coalesce(reach.n, 0) AS allowed_chapters
       FROM v_selection s LEFT JOIN v_coverage c ON c.session_id = s.session_id AND c.spine_index = s.spine_index
       LEFT JOIN v_near_text t ON t.session_id = s.session_id AND t.block_id = s.block_id AND t.text <> '' LEFT JOIN near ON near.session_id = s.session_id
       LEFT JOIN related r ON r.session_id = s.session_id LEFT JOIN v_analyses a ON a.spine_index = s.spine_index LEFT JOIN reach ON reach.session_id = s.session_id""",
)
def request_context(spark, folder):
    """The context of every explain request: clipped blocks, analysis and concepts, each compared by its content."""
    made = _assembled(spark, folder)
    line = lambda b: F.concat(b["block_id"], F.lit(":"), b["text"])
    return made.select(
        "request_id",
        "error",
        F.col("selected_block.block_id").alias("selected_id"),
        F.sha2("selected_block.text", 256).alias("selected_hash"),
        F.size("nearby_blocks").cast("long").alias("nearby"),
        F.when(F.size("nearby_blocks") > 0, F.sha2(F.array_join(F.transform("nearby_blocks", line), "\n"), 256)).alias("nearby_hash"),
        F.get_json_object("chapter_analysis", "$.summary.deep").alias("deep"),
        _named_concepts(),
        "allowed_chapters",
    )


view(
    "v_passages",
    """SELECT spine_index, block_id, arg_min('Passage: ' || substring(text, 1, 20), idx) AS explanation FROM v_ref_rows WHERE kind = 2 GROUP BY ALL""",
)


@query(
    "difficult_passages",
    "SELECT session_id AS request_id, s.block_id, explanation FROM v_selection s LEFT JOIN v_passages p ON p.spine_index = s.spine_index AND p.block_id = s.block_id",
)
def difficult_passages(spark, folder):
    return actions.difficult_passages(qr.selections(spark, folder), package.chapter_analyses(spark, folder)).select(
        "request_id", "block_id", "explanation"
    )


@query(
    "explain_requests",
    f"""SELECT request_id, error, CASE WHEN error IS NULL THEN 'explanation-' || block_id END AS card_id,
         CASE WHEN error IS NULL THEN CASE WHEN has AND difficult IS NOT NULL THEN difficult WHEN has THEN deep ELSE '{actions.NO_ANALYSIS}' END END AS explanation,
         CASE WHEN error IS NULL THEN CASE WHEN has AND difficult IS NOT NULL THEN CAST(9000 AS BIGINT) ELSE 6500 END END AS confidence_basis_points FROM (
         SELECT s.session_id AS request_id, s.block_id, s.session_id IN (SELECT session_id FROM v_readable) AS has, p.explanation AS difficult,
           substring(a.joined, 1, 400) AS deep,
           CASE WHEN r.block_id IS NULL THEN 'outside_boundary' WHEN least(b.n_chars, 30) > r.visible THEN 'beyond_coverage'
                WHEN b.ord % 4 = 1 THEN 'selection_mismatch' END AS error
         FROM v_selection s JOIN v_blocks b ON b.block_id = s.block_id
         LEFT JOIN v_reading r ON r.session_id = s.session_id AND r.block_id = s.block_id
         LEFT JOIN v_passages p ON p.spine_index = s.spine_index AND p.block_id = s.block_id LEFT JOIN v_analyses a ON a.spine_index = s.spine_index)""",
)
def explain_requests(spark, folder):
    """Readers select the opening of their block; in some lines they misquote it."""
    blocks, cover, analyses, asked, readable = _context(spark, folder)
    spot = blocks.select("book_id", "spine_index", "block_id", "ord", "n_chars", "text", "fp")
    quoted = durable(asked.join(spot, ["book_id", "spine_index", "block_id"]).select(
        "request_id",
        "session_id",
        "book_id",
        "spine_index",
        "block_id",
        F.lit(0).cast("long").alias("start_char"),
        F.least("n_chars", F.lit(30)).cast("long").alias("end_char"),
        F.col("fp").alias("text_fingerprint"),
        F.when(F.col("ord") % 4 == 1, "misquoted").otherwise(F.substring("text", 1, 30)).alias("selected_text"),
    ))
    return actions.explain_requests(
        quoted,
        reading.visible_chars(blocks, cover, quoted),
        actions.difficult_passages(asked, analyses),
        readable,
        analyses,
    )


@query(
    "checkpoint_requests",
    """SELECT s.session_id AS request_id, s.spine_index, CASE WHEN c.session_id IS NULL THEN 'forbidden' WHEN NOT coalesce(v.completed, false) THEN 'beyond_coverage' END AS error,
         CASE WHEN coalesce(v.completed, false) THEN 'checkpoint-card-checkpoint-' || s.spine_index END AS card_id
       FROM v_sessions s LEFT JOIN v_coverage c ON c.session_id = s.session_id AND c.spine_index = s.spine_index
       LEFT JOIN v_covered v ON v.session_id = s.session_id AND v.spine_index = s.spine_index""",
)
def checkpoint_requests(spark, folder):
    blocks, cover = base.blocks(spark, folder), reader.coverage(spark, folder)
    asked = durable(reader.sessions(spark, folder)).select(F.col("session_id").alias("request_id"), "session_id", "book_id", "spine_index")
    points = package.checkpoints(package.chapter_analyses(spark, folder))
    return actions.checkpoint_requests(asked, cover, reading.covered_chapters(blocks, cover), points).select(
        "request_id", "spine_index", "error", "card_id"
    )


_PLAIN = r"list_transform(list_filter(string_split_regex({0}, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) > 1), lambda w: lower(w))"

view(
    "v_answers",
    f"""SELECT conv_id, turn, least(10000, len(list_intersect(list_distinct({_PLAIN.format('text')}), e)) * 10000 // nullif(len(e), 0)) AS score, spine_index FROM (
         SELECT c.*, a.spine_index, list_distinct(flatten(list_transform(a.key_ideas, lambda p: {_PLAIN.format('p')}))) AS e
         FROM conversations c JOIN v_analyses a ON a.spine_index = c.conv_id WHERE c.role = 'assistant')""",
)


def answered(spark, folder):
    """Assistant turns as answers about the chapter with the conversation's number."""
    conv = base.table(spark, folder, "conversations").where("role = 'assistant'").withColumnRenamed("text", "answer")
    ideas = package.chapter_analyses(spark, folder).select(
        "book_id", F.col("spine_index").alias("conv_id"), F.col("key_ideas").alias("expected_points")
    )
    return actions.reflection_score(conv.join(ideas, "conv_id"))


@query(
    "reflection_score",
    f"""SELECT conv_id, turn, CAST(coalesce(score, 0) AS BIGINT) AS score_basis_points, CASE WHEN score >= 7000 THEN '{actions.FEEDBACK[0]}'
         WHEN score >= 3000 THEN '{actions.FEEDBACK[1]}' ELSE '{actions.FEEDBACK[2]}' END AS feedback FROM v_answers""",
)
def reflection_score(spark, folder):
    return answered(spark, folder).select("conv_id", "turn", "score_basis_points", "feedback")


@query(
    "weak_concepts",
    """SELECT DISTINCT 'u' || a.conv_id AS session_id, c.concept_id, c.name FROM v_answers a JOIN v_references r ON r.owner = 'card-' || a.spine_index
       JOIN v_concepts c ON c.concept_id = r.id WHERE coalesce(a.score, 0) < 7000""",
)
def weak_concepts(spark, folder):
    analyses = package.chapter_analyses(spark, folder)
    records = answered(spark, folder).select(
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("session_id"),
        "book_id",
        F.col("conv_id").alias("spine_index"),
        "score_basis_points",
    )
    return actions.weak_concepts(records, package.checkpoints(analyses), package.concepts(analyses))


@query(
    "summary_cards",
    """SELECT 'summary-' || a.chapter_id AS card_id, c.title, coalesce(k.n, 0) AS n_refs,
         CASE WHEN k.n > 0 THEN CAST(9000 AS BIGINT) ELSE 6000 END AS confidence_basis_points, CASE WHEN k.n > 0 THEN 'grounded' ELSE 'inferred' END AS grounding
       FROM v_analyses a JOIN v_chapters c USING (spine_index) LEFT JOIN (
         SELECT spine_index, count(*) AS n FROM (SELECT *, lag(block_id || start_char || '-' || end_char || text_fingerprint) OVER (PARTITION BY spine_index ORDER BY block_id, seq) AS before FROM v_chapter_cites)
         WHERE before IS DISTINCT FROM block_id || start_char || '-' || end_char || text_fingerprint GROUP BY spine_index) k USING (spine_index)""",
)
def summary_cards(spark, folder):
    return actions.summary_cards(grounding.chapter_refs(package.chapter_analyses(spark, folder))).drop("source_refs", "spine_index")


view(
    "v_cards",
    """SELECT conv_id || '-' || turn AS request_id, 'u' || conv_id AS session_id, CASE WHEN n % 17 = 0 THEN ' ' ELSE 'card-' || turn END AS card_id,
         n % 10 * 1200 AS confidence_basis_points, CASE WHEN n % 4 = 0 THEN 'inferred' ELSE 'grounded' END AS grounding, n % 7 <> 0 AS cites,
         CASE WHEN n % 5 = 0 THEN 'full_book_allowed' ELSE 'within_boundary' END AS spoiler_status, CASE WHEN n % 9 = 0 THEN 'delete' ELSE 'quiz' END AS action, n, conv_id, turn
       FROM (SELECT *, length(text) AS n FROM conversations WHERE role = 'assistant')""",
)


def cards(spark, folder):
    n = F.char_length("text")
    conv = base.table(spark, folder, "conversations").where("role = 'assistant'")
    return conv.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("session_id"),
        F.when(n % 17 == 0, " ").otherwise(F.concat(F.lit("card-"), F.col("turn").cast("string"))).alias("card_id"),
        F.lit("Answer").alias("title"),
        (n % 10 * 1200).alias("confidence_basis_points"),
        F.when(n % 4 == 0, "inferred").otherwise("grounded").alias("grounding"),
        F.when(n % 7 != 0, 1).otherwise(0).alias("n_refs"),
        F.when(n % 5 == 0, "full_book_allowed").otherwise("within_boundary").alias("spoiler_status"),
        F.lit("read_range").alias("spoiler_mode"),
        F.array(F.when(n % 9 == 0, "delete").otherwise("quiz")).alias("actions"),
        n.cast("long").alias("n"),
        "conv_id",
        "turn",
    )


view(
    "v_card_refs",
    """SELECT request_id, session_id, CASE WHEN n % 31 = 0 THEN 'gone' ELSE b.block_id END AS block_id, 0 AS start_char, least(b.n_chars, n % 50) + CASE WHEN n % 37 = 0 THEN b.n_chars ELSE 0 END AS end_char,
         CASE WHEN n % 29 = 0 THEN 'x' ELSE b.fp END AS text_fingerprint
       FROM v_cards JOIN v_blocks b ON b.spine_index = conv_id % 20 + 20 * (turn % 10) AND b.ord = 0 WHERE cites""",
)


def card_refs(spark, folder):
    spot = base.blocks(spark, folder).where("ord = 0").select("book_id", "spine_index", "block_id", "n_chars", "fp")
    n = F.col("n")
    rows = cards(spark, folder).where("n_refs > 0").withColumn("spine_index", F.col("conv_id") % 20 + 20 * (F.col("turn") % 10))
    rows = rows.withColumn("book_id", F.format_string("src%d", F.col("conv_id") % 20))
    return rows.join(spot, ["book_id", "spine_index"]).select(
        "request_id",
        "session_id",
        "book_id",
        F.when(n % 31 == 0, "gone").otherwise(F.col("block_id")).alias("block_id"),
        F.lit(0).cast("long").alias("start_char"),
        (F.least(F.col("n_chars"), n % 50) + F.when(n % 37 == 0, F.col("n_chars")).otherwise(0)).alias("end_char"),
        F.when(n % 29 == 0, "x").otherwise(F.col("fp")).alias("text_fingerprint"),
    )


@query(
    "validate_cards",
    """SELECT request_id, 'blank_id_or_title' AS code FROM v_cards WHERE trim(card_id) = '' UNION ALL SELECT request_id, 'confidence_out_of_range' FROM v_cards WHERE confidence_basis_points > 10000
       UNION ALL SELECT request_id, 'grounded_without_refs' FROM v_cards WHERE grounding = 'grounded' AND NOT cites
       UNION ALL SELECT request_id, 'status_mismatch' FROM v_cards WHERE spoiler_status <> 'within_boundary' UNION ALL SELECT request_id, 'unknown_action' FROM v_cards WHERE action = 'delete'
       UNION ALL SELECT * FROM (SELECT r.request_id, CASE WHEN b.fp IS NULL THEN 'unknown_block' WHEN c.end_ord IS NULL THEN 'outside_boundary'
           WHEN r.start_char >= r.end_char OR r.end_char > b.n_chars THEN 'invalid_range' WHEN r.text_fingerprint <> b.fp THEN 'fingerprint_mismatch'
           WHEN r.end_char > CASE WHEN b.ord < c.end_ord THEN b.n_chars WHEN b.ord = c.end_ord THEN least(c.end_offset, b.n_chars) ELSE 0 END THEN 'beyond_coverage' END AS code
         FROM v_card_refs r LEFT JOIN v_blocks b USING (block_id) LEFT JOIN v_coverage c ON c.session_id = r.session_id AND c.spine_index = b.spine_index) WHERE code IS NOT NULL""",
)
def validate_cards(spark, folder):
    own = actions.card_issues(cards(spark, folder))
    return own.unionByName(
        actions.card_reference_issues(card_refs(spark, folder), base.blocks(spark, folder), reader.coverage(spark, folder))
    )


@query(
    "card_reference_modes",
    """SELECT request_id, code FROM (SELECT r.request_id, CASE WHEN b.fp IS NULL THEN 'unknown_block'
           WHEN mode = 'read_range' AND c.end_ord IS NULL OR mode = 'current_chapter' AND b.spine_index IS DISTINCT FROM s.spine_index THEN 'outside_boundary'
           WHEN r.start_char >= r.end_char OR r.end_char > b.n_chars THEN 'invalid_range' WHEN r.text_fingerprint <> b.fp THEN 'fingerprint_mismatch'
           WHEN mode = 'read_range' AND r.end_char > CASE WHEN b.ord < c.end_ord THEN b.n_chars WHEN b.ord = c.end_ord THEN least(c.end_offset, b.n_chars) ELSE 0 END THEN 'beyond_coverage' END AS code
         FROM (SELECT *, ['read_range', 'current_chapter', 'full_book'][length(request_id) % 3 + 1] AS mode FROM v_card_refs) r
         LEFT JOIN v_blocks b USING (block_id) LEFT JOIN v_coverage c ON c.session_id = r.session_id AND c.spine_index = b.spine_index LEFT JOIN v_sessions s ON s.session_id = r.session_id)
       WHERE code IS NOT NULL""",
)
def card_reference_modes(spark, folder):
    """The same citations under the three spoiler modes in turn."""
    modes = F.array(F.lit("read_range"), F.lit("current_chapter"), F.lit("full_book"))
    now = reader.sessions(spark, folder).select("session_id", F.col("spine_index").alias("current_spine"))
    refs = card_refs(spark, folder).join(now, "session_id", "left").withColumn(
        "spoiler_mode", F.element_at(modes, F.char_length("request_id") % 3 + 1)
    )
    return actions.card_reference_issues(refs, base.blocks(spark, folder), reader.coverage(spark, folder))


@query(
    "citations_supplied",
    """SELECT r.request_id, r.block_id FROM v_card_refs r ANTI JOIN (
         SELECT session_id, block_id, visible, fp FROM v_reading WHERE visible > 0) o
       ON o.session_id = r.session_id AND o.block_id = r.block_id AND r.start_char = 0 AND r.end_char = o.visible AND r.text_fingerprint = o.fp""",
)
def citations_supplied(spark, folder):
    """Card citations against the full visible ranges their session could be offered."""
    refs = card_refs(spark, folder)
    seen = reading.visible_chars(base.blocks(spark, folder), reader.coverage(spark, folder)).where("visible > 0")
    offered = refs.select("request_id", "session_id").distinct().join(
        seen.select("session_id", "block_id", F.col("visible").alias("end_char"), F.col("fp").alias("text_fingerprint")), "session_id"
    )
    return actions.citations_supplied(refs, offered.withColumn("start_char", F.lit(0).cast("long"))).select("request_id", "block_id")


@query(
    "append_unseen",
    """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY spine_index ORDER BY ord) AS pos FROM v_blocks),
       near AS (SELECT s.session_id AS request_id, p.block_id FROM v_selection s JOIN placed a ON a.spine_index = s.spine_index AND a.block_id = s.block_id
           JOIN placed p ON p.spine_index = s.spine_index AND p.pos BETWEEN a.pos - 1 AND a.pos + 1
         UNION ALL SELECT s.session_id, p.block_id FROM v_selection s JOIN placed p USING (spine_index) WHERE s.block_id IS NULL AND p.pos <= 3)
       SELECT request_id, block_id, 'nearby' AS origin FROM near
       UNION ALL SELECT r.session_id, r.block_id, 'retrieved' FROM (SELECT session_id, block_id FROM v_reading WHERE visible > 0) r
         ANTI JOIN near n ON n.request_id = r.session_id AND n.block_id = r.block_id""",
)
def append_unseen(spark, folder):
    """Nearby blocks plus everything else the session may see."""
    blocks = base.blocks(spark, folder)
    near = reading.nearby_blocks(durable(qr.selections(spark, folder)), blocks)
    seen = reading.visible_chars(blocks, reader.coverage(spark, folder)).where("visible > 0")
    return actions.append_unseen(near, seen.select(F.col("session_id").alias("request_id"), "block_id"))


@query(
    "card_rules",
    """SELECT card_id, card_type, unnest(list_filter([CASE WHEN title = '' THEN 'blank_title' END,
         CASE WHEN card_type = 'explanation' AND title = '' THEN 'blank_passage' END,
         CASE WHEN card_type = 'concept' AND title = '' THEN 'blank_name' END,
         CASE WHEN card_type = 'explanation' AND spine_index % 5 = 0 THEN 'missing_sources' END,
         CASE WHEN card_type = 'checkpoint' AND spine_index % 7 = 0 THEN 'empty_must_understand' END,
         CASE WHEN spine_index % 4 = 1 AND spine_index % 5 = 0 THEN 'empty_action' END,
         CASE WHEN spine_index % 4 = 2 AND title = '' THEN 'empty_action' END], lambda x: x IS NOT NULL)) AS code
       FROM (SELECT *, 'card-' || spine_index AS card_id, ['explanation', 'concept', 'checkpoint'][spine_index % 3 + 1] AS card_type FROM v_chapters)""",
)
def card_rules(spark, folder):
    """Protocol cards made from chapters: explanation, concept and checkpoint in turn."""
    s = F.col("spine_index")
    text = s.cast("string")
    action = F.when(s % 4 == 1, "explain_more").when(s % 4 == 2, "quiz_me")
    made = base.chapters(spark, folder).select(
        F.concat(F.lit("card-"), text).alias("card_id"),
        "book_id",
        "title",
        F.element_at(F.array(F.lit("explanation"), F.lit("concept"), F.lit("checkpoint")), (s % 3 + 1).cast("int")).alias("card_type"),
        F.create_map(
            F.lit("passage"), F.col("title"), F.lit("explanation"), F.lit("Because."), F.lit("concept_id"), text, F.lit("name"), F.col("title"),
            F.lit("definition_in_this_book"), F.lit("A chapter."), F.lit("checkpoint_id"), text, F.lit("chapter_id"), text,
        ).alias("fields"),
        (s % 5).alias("n_sources"),
        (s % 7).alias("n_must_understand"),
        action.alias("action"),
        F.col("title").alias("action_chapter"),
        F.lit(0).alias("n_action_concepts"),
        (s % 5).alias("n_action_sources"),
    )
    return actions.protocol_card_issues(made)


@query(
    "request_rules",
    """SELECT request_id, 'empty_answer' AS code FROM v_reqs WHERE task = 'reflect' AND role = 'system'
       UNION ALL SELECT request_id, 'empty_question' FROM v_reqs WHERE task = 'ask' AND role = 'system'
       UNION ALL SELECT request_id, 'progress_out_of_range' FROM v_reqs WHERE progress > 10000
       UNION ALL SELECT request_id, 'empty_patch' FROM v_reqs WHERE task = 'patch' AND progress IS NULL""",
)
def request_rules(spark, folder):
    conv = base.table(spark, folder, "conversations")
    n = F.char_length("text")
    task = F.element_at(F.array(F.lit("ask"), F.lit("reflect"), F.lit("patch")), (F.col("turn") % 3 + 1).cast("int"))
    spoken = F.when(F.col("role") != "system", F.col("text"))
    made = conv.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        task.alias("task"),
        spoken.alias("question"),
        spoken.alias("selected_text"),
        spoken.alias("answer"),
        F.when(task != "patch", "chapter_001").alias("chapter_id"),
        F.when(n % 3 != 0, n * 20).alias("progress_basis_points"),
        F.lit(None).cast("string").alias("mode"),
        n.alias("content_bytes"),
    )
    return actions.request_issues(made)


view(
    "v_reqs",
    """SELECT conv_id || '-' || turn AS request_id, ['ask', 'reflect', 'patch'][turn % 3 + 1] AS task, role,
         CASE WHEN length(text) % 3 <> 0 THEN length(text) * 20 END AS progress FROM conversations""",
)
