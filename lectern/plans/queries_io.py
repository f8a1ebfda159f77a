"""Source and sink queries: pages, navigation, exports, written and re-read files."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.functions import text as T
from lectern.operators import corpus, grounding, reading
from lectern.operators import sections as section_operators
from lectern.plans import base, package, reader, suite_data
from lectern.plans import queries_reading as qr
from lectern.plans import queries_scoring as qs
from lectern.plans.registry import query, view
from lectern.session import checkpoint_dir, durable, spread
from lectern.sinks import exports
from lectern.sources import files, markup


def scratch(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/lectern-{uuid.uuid4().hex}"


def pages(spark, folder):
    return spread(base.table(spark, folder, "pages").select("page_id", "url", "html"), "page_id")


@query("extract_blocks")
def extract_blocks(spark, folder):
    """All text blocks of all pages (parser semantics; see tests for the fixture checks)."""
    return markup.extract_blocks(pages(spark, folder), ["page_id"]).select(
        "page_id", "ord", "kind", "text", "level", F.size("links").cast("long").alias("n_links")
    )


def _sql_decode(expr):
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


@query(
    "page_headings",
    f"""SELECT page_id, CAST(1 AS BIGINT) AS level, 'heading' AS kind, {base.sql_norm(_sql_decode("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))} AS text FROM pages""",
)
def page_headings(spark, folder):
    blocks = markup.extract_blocks(pages(spark, folder), ["page_id"]).where("level is not null")
    return blocks.select("page_id", "level", "kind", "text")


@query(
    "heading_levels",
    """SELECT book_id, level, CAST(least(dense_rank() OVER (PARTITION BY book_id ORDER BY level), 6) AS BIGINT) AS normalised_level FROM (
         SELECT DISTINCT CAST(spine_index AS VARCHAR) AS book_id, greatest(1, least(6, n_chars % 9)) AS level FROM v_blocks)""",
)
def heading_levels(spark, folder):
    """Documents as books whose lines are headings of a level from their length, some beyond 1 to 6."""
    level = (F.col("n_chars") % 9).alias("level")
    return corpus.heading_levels(base.blocks(spark, folder).select(F.col("spine_index").cast("string").alias("book_id"), level))


@query(
    "extract_toc",
    """SELECT page_id, i - 1 AS pos, CAST(1 AS BIGINT) AS depth, labels[i] AS label, hrefs[i] AS href, true AS is_leaf FROM (
         SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM (
           SELECT page_id, regexp_extract_all(nav, '<li><a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a>', 1) AS labels
           FROM (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages)))""",
)
def extract_toc(spark, folder):
    return markup.extract_toc(pages(spark, folder), ["page_id"]).drop("path")


@query(
    "strip_markup",
    rf"""SELECT page_id, {base.sql_norm("regexp_replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '', 'g')")} AS stripped,
         replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') AS title,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""",
)
def strip_markup(spark, folder):
    return pages(spark, folder).select(
        "page_id",
        T.strip_markup(F.col("html")).alias("stripped"),
        T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        T.attribute(F.regexp_extract("html", r"<(html[^>]*)>", 1), "lang").alias("lang"),
    )


@query(
    "link_footnotes",
    """SELECT a.spine_index, a.block_id AS source_block_id, b.block_id AS note_block_id FROM v_blocks a JOIN v_blocks b
         ON b.spine_index = a.spine_index AND b.ord = a.ord + a.n_chars % 3 WHERE b.block_id <> a.block_id""",
)
def link_footnotes(spark, folder):
    """Every block links to the note one, two or (itself) zero lines below."""
    blocks = base.blocks(spark, folder).select("book_id", "spine_index", F.col("ord").alias("node_id"), "block_id", "n_chars")
    fragment = lambda c: F.concat(F.lit("note-"), c.cast("string"))
    links = blocks.select("book_id", "spine_index", "node_id", fragment(F.col("node_id") + F.col("n_chars") % 3).alias("fragment"))
    notes = blocks.select("book_id", "spine_index", fragment(F.col("node_id")).alias("note_id"), "block_id")
    return corpus.link_footnotes(links, blocks, notes).drop("book_id")


@query(
    "spine_hrefs",
    "SELECT book_id, spine_index, CASE WHEN spine_index % 9 <> 0 THEN href END AS href FROM v_chapters",
)
def spine_hrefs(spark, folder):
    """Spine references into a manifest that lacks some items."""
    rows = base.chapters(spark, folder)
    spine = rows.select("book_id", "spine_index", F.concat(F.lit("i"), F.col("spine_index").cast("string")).alias("idref"))
    manifest = rows.where("spine_index % 9 <> 0").select(
        "book_id", F.concat(F.lit("i"), F.col("spine_index").cast("string")).alias("id"), "href", F.lit("application/xhtml+xml").alias("media_type")
    )
    return corpus.spine_hrefs(spine, manifest).select("book_id", "spine_index", "href")


@query(
    "blocks_jsonl",
    "SELECT book_id, block_id, spine_index AS chapter_index, ord AS \"order\", sha256(text) AS text_fingerprint, href AS chapter_href FROM v_blocks",
)
def blocks_jsonl(spark, folder):
    """Blocks written as JSON lines and read back."""
    path = scratch(spark)
    exports.write_blocks_jsonl(base.blocks(spark, folder), path)
    rows = spark.read.schema(files.BLOCK_SCHEMA).json(path)
    return rows.select(
        "book_id", "block_id", "chapter_index", "order", "text_fingerprint", F.col("source_ref.chapter_href").alias("chapter_href")
    )


@query(
    "jsonl_equals_book",
    "SELECT book_id, CAST(0 AS BIGINT) AS only_left, count(*) FILTER (ord % 6 = 5) AS only_right FROM v_blocks GROUP BY book_id",
)
def jsonl_equals_book(spark, folder, blocks=None):
    """A written stream that lacks every sixth line, against the blocks, order included."""
    fields = ["book_id", "block_id", "chapter_index", "order", "text"]
    path = scratch(spark)
    blocks = base.blocks(spark, folder) if blocks is None else blocks
    exports.write_blocks_jsonl(blocks.where("ord % 6 <> 5"), path)
    stored = spark.read.schema(files.BLOCK_SCHEMA).json(path).select(*fields)
    return grounding.same_rows(stored, exports.block_documents(blocks).select(*fields), ["book_id"])


@query(
    "read_packages",
    f"""SELECT CASE WHEN spine_index % 5 <> 0 THEN book_id END AS book_id, CASE WHEN spine_index % 5 <> 0 THEN href END AS block_id,
         CASE WHEN spine_index % 5 <> 0 THEN spine_index END AS chapter_index, CASE WHEN spine_index % 5 <> 0 THEN title END AS text,
         CASE WHEN spine_index % 5 = 0 THEN sha256('{{' || CAST(to_json({{'book_id': book_id, 'block_id': href, 'chapter_index': spine_index, 'text': title}}) AS VARCHAR)) END AS corrupt
       FROM v_chapters WHERE spine_index % 7 <> 0""",
)
def read_packages(spark, folder):
    """One JSON line per chapter, some cut short, some blank: every row as it is read back, broken lines by their hash."""
    path = scratch(spark)
    s = F.col("spine_index")
    line = F.to_json(F.struct(F.col("book_id"), F.col("href").alias("block_id"), s.alias("chapter_index"), F.col("title").alias("text")))
    lines = base.chapters(spark, folder).select(
        F.when(s % 7 == 0, F.lit("")).when(s % 5 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")
    )
    lines.write.text(path)
    rows = files.read_packages(spark, path)
    good = F.col(files.BAD).isNull()
    kept = [F.when(good, F.col(c)).alias(c) for c in ("book_id", "block_id", "chapter_index", "text")]
    return rows.select(*kept, F.sha2(files.BAD, 256).alias("corrupt"))


@query(
    "read_call_ledger",
    """SELECT CASE WHEN k <> 13 THEN CAST(event_id AS VARCHAR) END AS id, CASE WHEN k = 13 THEN 'interrupted' WHEN k % 10 = 1 THEN 'interrupted' ELSE 'completed' END AS status,
         CASE WHEN k <> 13 THEN k * 11 END AS input_bytes FROM v_events""",
)
def read_call_ledger(spark, folder):
    """Call events written as JSON; some have no status, some are unreadable."""
    path = scratch(spark)
    ev = reader.events(spark, folder)
    k = F.col("k")
    body = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.when(k % 10 != 1, "completed").alias("status"),
            (k * 11).alias("input_bytes"),
        )
    )
    ev.select(F.when(k == 13, F.lit('{"id": ')).otherwise(body).alias("value")).write.text(path)
    # An unreadable event is named after its file.
    known = F.when(F.col("input_bytes").isNotNull(), F.col("id"))
    return files.read_call_ledger(spark, path).select(known.alias("id"), "status", "input_bytes")


def suite_tables(spark, folder):
    """Suite files written from documents and conversations, then loaded."""
    root = scratch(spark)
    items = corpus.chapter_items(base.chapters_raw(spark, folder))
    paragraphs = F.transform(
        "items",
        lambda b: F.struct(
            F.concat(F.lit("p"), F.when(b["ord"] == 3, 2).otherwise(b["ord"]).cast("string")).alias("id"),
            b["text"].alias("text"),
            F.when(b["ord"] % 17 == 5, "bad").otherwise(F.sha2(b["text"], 256)).alias("sha256"),
        ),
    )
    chapter = F.struct(F.col("href"), F.col("title"), paragraphs.alias("paragraphs"))
    books = items.select(
        F.concat(F.lit("b"), F.col("spine_index").cast("string")).alias("id"),
        F.col("book_id").alias("family"),
        F.lit("en").alias("language"),
        "title",
        F.lit("CC0").alias("license"),
        F.array(chapter).alias("chapters"),
    )
    books.write.json(f"{root}/books")
    conv = base.table(spark, folder, "conversations").where("role = 'user'")
    n = F.char_length("text")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    step = F.struct(
        F.when(n % 2 == 0, "ask").otherwise("reflect").alias("task"),
        F.when(n % 13 != 0, F.col("text")).alias("question"),
        F.when(n % 3 != 0, F.when(n % 5 == 0, "p99999").otherwise("p0")).alias("selection"),
        F.when(n % 7 != 0, "an answer").alias("answer"),
        F.array(F.struct(F.lit("p0").alias("anchor"), F.when(n % 11 == 0, 10_000_000).cast("long").alias("end_char"))).alias("read"),
    )
    cases = conv.select(
        name.alias("id"),
        F.concat(F.lit("b"), F.when(n % 17 == 0, "x").otherwise(F.col("conv_id").cast("string"))).alias("book_id"),
        F.lit("regression").alias("suite"),
        F.array(F.lit("D01")).alias("dimensions"),
        F.when(n % 19 == 0, "not_applicable").otherwise("applicable").alias("applicability"),
        F.array(step).alias("steps"),
    )
    cases.write.json(f"{root}/cases")
    gold = conv.where("turn < 4").select(
        name.alias("case_id"),
        F.when(n % 2 == 0, "reviewed").otherwise("draft").alias("status"),
        F.when(n % 4 != 0, "r").alias("reviewer"),
        F.array(F.array(F.when(n % 6 == 0, "p77777").otherwise("p0"))).alias("evidence_sets"),
        F.lit(True).alias("answerable"),
    )
    gold.write.json(f"{root}/gold")
    suite = files.load_suite(spark, f"{root}/books", f"{root}/cases", f"{root}/gold")
    book_schema = (
        "id string, family string, language string, title string, license string, "
        "chapters array<struct<href:string,title:string,paragraphs:array<struct<id:string,text:string,sha256:string>>>>"
    )
    return suite, spark.read.schema(book_schema).json(f"{root}/books")


view(
    "v_suite_cases",
    """SELECT conv_id || '-' || turn AS case_id, length(text) AS n, turn, CASE WHEN length(text) % 17 = 0 THEN 'bx' ELSE 'b' || conv_id END AS book_id, conv_id
       FROM conversations WHERE role = 'user'""",
)
view(
    "v_suite_anchors",
    """SELECT 'b' || spine_index AS book_id, 'p' || CASE WHEN ord = 3 THEN 2 ELSE ord END AS anchor, count(*) AS copies, max(n_chars) AS n_chars,
         count(*) FILTER (ord % 17 = 5) AS bad FROM v_blocks GROUP BY ALL""",
)


@query(
    "suite_integrity",
    """SELECT 'anchor' AS scope, book_id || '/' || anchor AS id, 'duplicate_anchor' AS code FROM v_suite_anchors WHERE copies > 1
       UNION ALL SELECT 'anchor', book_id || '/' || anchor, 'paragraph_hash_mismatch' FROM (SELECT *, unnest(range(0, bad)) FROM v_suite_anchors WHERE bad > 0)
       UNION ALL SELECT 'case', case_id, 'unknown_book' FROM v_suite_cases WHERE book_id NOT IN (SELECT 'b' || spine_index FROM v_chapters)
       UNION ALL SELECT 'case', case_id, 'reason_required' FROM v_suite_cases WHERE n % 19 = 0
       UNION ALL SELECT 'case', case_id, 'question_required' FROM v_suite_cases WHERE n % 2 = 0 AND n % 13 = 0
       UNION ALL SELECT 'case', case_id, 'selection_required' FROM v_suite_cases WHERE n % 2 = 1 AND n % 3 = 0
       UNION ALL SELECT 'case', case_id, 'reflection_question_required' FROM v_suite_cases WHERE n % 2 = 1 AND n % 13 = 0
       UNION ALL SELECT 'case', case_id, 'answer_required' FROM v_suite_cases WHERE n % 2 = 1 AND n % 7 = 0
       UNION ALL SELECT 'case', case_id, 'unknown_anchor' FROM v_suite_cases c WHERE n % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM v_suite_anchors a WHERE a.book_id = c.book_id AND a.anchor = CASE WHEN n % 5 = 0 THEN 'p99999' ELSE 'p0' END)
       UNION ALL SELECT 'case', case_id, 'unknown_anchor' FROM v_suite_cases c WHERE NOT EXISTS (SELECT 1 FROM v_suite_anchors a WHERE a.book_id = c.book_id AND a.anchor = 'p0')
       UNION ALL SELECT 'case', case_id, 'endpoint_out_of_bounds' FROM v_suite_cases c WHERE n % 11 = 0 AND EXISTS (SELECT 1 FROM v_suite_anchors a WHERE a.book_id = c.book_id AND a.anchor = 'p0')
       UNION ALL SELECT 'gold', case_id, 'unknown_evidence' FROM v_suite_cases c WHERE turn < 4 AND NOT EXISTS (SELECT 1 FROM v_suite_anchors a WHERE a.book_id = c.book_id AND a.anchor = CASE WHEN n % 6 = 0 THEN 'p77777' ELSE 'p0' END)
       UNION ALL SELECT 'case', case_id, 'missing_gold' FROM v_suite_cases WHERE turn >= 4
       UNION ALL SELECT 'gold', case_id, 'reviewer_required' FROM v_suite_cases WHERE turn < 4 AND n % 4 = 0""",
)
def suite_integrity(spark, folder):
    suite, books = suite_tables(spark, folder)
    chapters = books.select(F.col("id").alias("book_id"), F.posexplode("chapters").alias("chapter", "c"))
    suite["books"] = books.drop("chapters")
    suite["chapters"] = chapters.select("book_id", "chapter", F.col("c.href").alias("href"))
    suite["paragraphs"] = chapters.select("book_id", "chapter", F.explode("c.paragraphs").alias("p")).select(
        "book_id", "chapter", F.col("p.id").alias("anchor"), "p.text", "p.sha256"
    )
    return files.suite_integrity(suite)


@query(
    "record_rules",
    """SELECT event_id, 'maximum_k' AS code FROM v_events WHERE k > 90 UNION ALL SELECT event_id, 'minimum_k' FROM v_events WHERE k < 5
       UNION ALL SELECT event_id, 'unknown_field' FROM v_events WHERE event_type = 'error' UNION ALL SELECT event_id, 'missing_kind' FROM v_events WHERE event_type = 'signup'
       UNION ALL SELECT event_id, 'enum_kind' FROM v_events WHERE event_type = 'purchase'""",
)
def record_rules(spark, folder):
    """Event properties with their type mixed in, checked against a small schema."""
    ev = base.table(spark, folder, "events")
    tail = (
        F.when(F.col("event_type") == "signup", "}")
        .when(F.col("event_type") == "error", ', "kind": "error", "extra": 1}')
        .otherwise(F.concat(F.lit(', "kind": "'), "event_type", F.lit('"}')))
    )
    rows = ev.select("event_id", F.concat(F.regexp_replace("props", r"\}$", ""), tail).alias("json"))
    fields = {
        "k": {"required": True, "type": "integer", "minimum": 5, "maximum": 90},
        "kind": {"required": True, "enum": ["view", "click", "error"], "min_length": 2},
    }
    return files.record_rules(rows, "event_id", "json", fields)


@query(
    "markdown_to_blocks",
    r"""SELECT doc_id, i - 1 AS pos, (i - 1) // 100 AS batch,
         CASE WHEN regexp_matches(line, '^#{1,3}\s+.+$') THEN 'heading_' || length(regexp_extract(line, '^(#{1,3})\s', 1)) WHEN regexp_matches(line, '^[-*]\s+.+$') THEN 'bulleted_list_item' ELSE 'paragraph' END AS type,
         substring(CASE WHEN regexp_matches(line, '^#{1,3}\s+.+$') THEN regexp_extract(line, '^#{1,3}\s+(.+)$', 1) WHEN regexp_matches(line, '^[-*]\s+.+$') THEN regexp_extract(line, '^[-*]\s+(.+)$', 1)
           ELSE regexp_replace(line, '^>\s?', '') END, 1, 2000) AS content
       FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
         SELECT doc_id, list_filter(string_split_regex('# ' || replace(replace(text, chr(10) || 'T', chr(10) || '- T'), chr(10) || 'E', chr(10) || '> E'), '\r?\n'), lambda s: s <> '') AS ls FROM documents))""",
)
def markdown_to_blocks(spark, folder):
    """Documents dressed as markdown: a heading, some bullets, some quotes."""
    docs = spread(base.table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    dressed = F.replace(F.replace(F.col("text"), F.lit("\nT"), F.lit("\n- T")), F.lit("\nE"), F.lit("\n> E"))
    return exports.markdown_to_blocks(docs.select("doc_id", F.concat(F.lit("# "), dressed).alias("markdown")), "doc_id")


view(
    "v_ok_notes",
    "SELECT * FROM v_checked_notes WHERE error IS NULL",
)


@query(
    "export_scope",
    """SELECT 'e' || session_id AS export_id, spine_index, CAST(NULL AS VARCHAR) AS error FROM v_covered WHERE completed
       UNION ALL SELECT 'w' || book_id, spine_index, NULL FROM v_chapters WHERE NOT is_noise
       UNION ALL SELECT 'c' || doc_id, doc_id * 3, CASE WHEN doc_id * 3 NOT IN (SELECT doc_id FROM documents) OR (doc_id * 3) % 20 <> doc_id % 20 THEN 'unknown_chapter' END FROM documents""",
)
def export_scope(spark, folder):
    """A whole-book export per book, a read-range export per reader, a one-chapter export per document."""
    chapters = base.chapters(spark, folder)
    empty = F.array().cast("array<bigint>")
    none = F.lit(None).cast("string")
    whole = chapters.select("book_id").distinct().select(
        F.concat(F.lit("w"), "book_id").alias("export_id"), "book_id", F.lit("whole_book").alias("scope"), empty.alias("chapter_ids"), none.alias("session_id")
    )
    listed = chapters.select(
        F.concat(F.lit("c"), F.col("spine_index").cast("string")).alias("export_id"),
        "book_id",
        F.lit("chapters").alias("scope"),
        F.array(F.col("spine_index") * 3).alias("chapter_ids"),
        none.alias("session_id"),
    )
    read = reader.sessions(spark, folder).select(
        F.concat(F.lit("e"), "session_id").alias("export_id"), "book_id", F.lit("read_range").alias("scope"), empty.alias("chapter_ids"), "session_id"
    )
    covered = reading.covered_chapters(base.blocks(spark, folder), reader.coverage(spark, folder))
    return exports.export_scope(chapters, whole.unionByName(listed).unionByName(read), covered)


view(
    "v_markdown",
    """SELECT c.book_id, c.spine_index AS pos, 0 AS line_no, '## ' || c.title AS line FROM v_chapters c WHERE NOT is_noise
       UNION ALL SELECT book_id, spine_index, 1, '' FROM v_chapters WHERE NOT is_noise
       UNION ALL SELECT book_id, spine_index, 2, CASE WHEN spine_index % 10 = 3 THEN '  ' ELSE substring(first_text, 1, 160) END FROM v_analyses
       UNION ALL SELECT book_id, spine_index, 3, '' FROM v_analyses
       UNION ALL SELECT book_id, spine_index, 3 + i, '- ' || key_ideas[i] FROM (SELECT *, unnest(range(1, len(key_ideas) + 1)) AS i FROM v_analyses)
       UNION ALL SELECT book_id, spine_index, 4 + len(key_ideas), '' FROM v_analyses
       UNION ALL SELECT n.book_id, n.spine_index, 1000000, '- 笔记：' || n.text FROM v_ok_notes n JOIN v_chapters c USING (book_id, spine_index) WHERE NOT is_noise""",
)


def ok_notes(spark, folder):
    return qr.checked_notes(spark, folder).where("error is null").select("book_id", "spine_index", "note_id", "text")


@query("export_markdown", "SELECT book_id, pos, CAST(line_no AS BIGINT) AS line_no, line FROM v_markdown")
def export_markdown(spark, folder):
    chapters = base.chapters(spark, folder).where("not is_noise")
    books = chapters.select("book_id").distinct().select(
        "book_id", F.col("book_id").alias("title"), F.lit("What does it say?").alias("central_question"), F.lit("It says this.").alias("thesis")
    )
    lines = exports.export_markdown(books, chapters, package.chapter_analyses(spark, folder), ok_notes(spark, folder))
    return lines.where("section = 1").select("book_id", "pos", F.col("line_no").cast("long").alias("line_no"), "line")


@query(
    "export_vault",
    r"""WITH named AS (SELECT *, printf('chapter_%03d', spine_index + 1) AS id, printf('chapter_%03d', spine_index + 1) || '-' || substring(regexp_replace(regexp_replace(title, '[^\p{L}\p{M}\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS name
         FROM v_chapters WHERE NOT is_noise)
       SELECT n.book_id, name || '.md' AS file_name, sha256('---' || chr(10) || 'book_id: ' || n.book_id || chr(10) || 'chapter_id: ' || id || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10)
           || CASE WHEN a.spine_index IS NOT NULL THEN substring(a.joined, 1, 400) || chr(10) || chr(10) || '## Key ideas' || chr(10) || chr(10) || array_to_string(list_transform(a.key_ideas, lambda i: '- ' || i || chr(10)), '') ELSE '' END
           || coalesce(chr(10) || '## Notes' || chr(10) || chr(10) || o.lines, '')) AS content_hash
       FROM named n LEFT JOIN v_analyses a USING (spine_index)
       LEFT JOIN (SELECT book_id, spine_index, string_agg('- ' || text || chr(10), '' ORDER BY note_id) AS lines FROM v_ok_notes GROUP BY ALL) o ON o.book_id = n.book_id AND o.spine_index = n.spine_index
       UNION ALL SELECT book_id, 'Book.md', sha256('- [[' || name || ']]' || chr(10)) FROM named""",
)
def export_vault(spark, folder):
    chapters = base.chapters(spark, folder).where("not is_noise")
    rows = exports.export_vault(chapters, package.chapter_analyses(spark, folder), ok_notes(spark, folder))
    return rows.select("book_id", "file_name", F.sha2("content", 256).alias("content_hash"))


@query(
    "export_json",
    """SELECT book_id, 'chapters' AS part, spine_index AS pos, CAST(spine_index AS VARCHAR) AS id FROM v_chapters WHERE length(title) > 30
       UNION ALL SELECT a.book_id, 'chapter_analyses', spine_index, a.chapter_id FROM v_analyses a JOIN v_chapters c USING (spine_index) WHERE length(c.title) > 30
       UNION ALL SELECT d.* FROM (
         SELECT book_id, 'concepts' AS part, spine_index, concept_id FROM v_concepts UNION ALL SELECT book_id, 'claims', spine_index, claim_id FROM v_claims
         UNION ALL SELECT book_id, 'entities', spine_index, entity_id FROM v_entities UNION ALL SELECT book_id, 'checkpoints', spine_index, 'checkpoint-' || spine_index FROM v_analyses
         UNION ALL SELECT book_id, 'book_map', spine_index, 'Carries the argument.' FROM v_cover WHERE subject = 'role'
         UNION ALL SELECT book_id, 'structure', spine_index, CAST(spine_index AS VARCHAR) FROM v_chapters UNION ALL SELECT book_id, 'manifest', 0, '0.1' FROM v_chapters GROUP BY book_id) d
       WHERE d.book_id IN (SELECT book_id FROM v_chapters WHERE length(title) > 30)""",
)
def export_json(spark, folder):
    """Chapters with a long title selected; everything else stays whole-book."""
    chapters = base.chapters(spark, folder)
    analyses = package.stored_analyses(spark, folder)
    whole = {
        "concepts": (package.concepts(analyses), "concept_id"),
        "claims": (package.claims(analyses), "claim_id"),
        "entities": (package.entities(analyses), "entity_id"),
        "checkpoints": (package.checkpoints(analyses), "checkpoint_id"),
        "book_map": (package.chapter_roles(analyses), "role"),
        "structure": (chapters.withColumn("id", F.col("spine_index").cast("string")), "id"),
        "manifest": (chapters.select("book_id").distinct().select("book_id", F.lit(0).cast("long").alias("spine_index"), F.lit("0.1").alias("format_version")), "format_version"),
    }
    rows = exports.export_json_rows(chapters.where("length(title) > 30"), chapters, analyses, whole)
    field = F.when(F.col("part") == "chapters", F.get_json_object("json", "$.spine_index")).when(
        F.col("part") == "chapter_analyses", F.get_json_object("json", "$.chapter_id")
    )
    for name, (_, key) in whole.items():
        field = field.when(F.col("part") == name, F.get_json_object("json", f"$.{key}"))
    return rows.select("book_id", "part", F.col("spine_index").alias("pos"), field.alias("id"))


@query(
    "structure_document",
    """SELECT book_id, CAST(0 AS BIGINT) AS section, 0 AS pos, '{"title":"' || book_id || '","spine_count":' || count(*) || ',"chapter_count":' || count(*) FILTER (NOT is_noise) || '}' AS json FROM v_chapters GROUP BY book_id
       UNION ALL SELECT book_id, 2, spine_index, '{"href":"' || href || '","linear":' || (NOT is_noise) || '}' FROM v_chapters
       UNION ALL SELECT book_id, 3, spine_index, '{"label":' || to_json(title) || ',"href":"' || href || '","depth":1}' FROM v_chapters WHERE NOT is_noise
       UNION ALL SELECT book_id, 1, spine_index, '{"spine_index":' || spine_index || ',"href":"' || href || '","title":' || to_json(title) || ',"block_count":' || block_count || ',"first_block_id":'
         || coalesce('"' || first_block_id || '"', 'null') || ',"last_block_id":' || coalesce('"' || last_block_id || '"', 'null') || ',"is_noise":' || is_noise || '}' FROM v_plain_rows""",
)
def structure_document(spark, folder):
    items = corpus.merge_paragraphs(corpus.chapter_items(base.chapters_raw(spark, folder)))
    chapters = corpus.chapter_rows(items)
    titles = chapters.select("book_id", F.col("book_id").alias("title")).distinct()
    toc = chapters.where("not is_noise").select("book_id", F.col("spine_index").alias("pos"), F.col("title").alias("label"), "href", F.lit(1).alias("depth"))
    return exports.structure_rows(chapters, titles, toc).select("book_id", F.col("section").cast("long").alias("section"), "pos", "json")


view(
    "v_plain_rows",
    """SELECT c.book_id, c.spine_index, c.href, c.title, c.is_noise, count(b.block_id) AS block_count, arg_min(b.block_id, b.ord) AS first_block_id, arg_max(b.block_id, b.ord) AS last_block_id
       FROM v_chapters c LEFT JOIN v_blocks b USING (spine_index) GROUP BY ALL""",
)


@query(
    "manifest",
    """SELECT book_id, CASE WHEN CAST(substring(book_id, 4) AS BIGINT) % 2 = 0 THEN '0.2' ELSE '0.1' END AS format_version, 'standard' AS profile, sha256(book_id) AS source_hash,
         CAST(sum(block_count) AS BIGINT) AS block_count, count(*) AS chapter_count FROM v_plain_rows GROUP BY book_id""",
)
def manifest(spark, folder):
    items = corpus.chapter_items(base.chapters_raw(spark, folder))
    counts = items.groupBy("book_id").agg(F.sum(F.size("items")).alias("block_count"), F.count(F.lit(1)).alias("chapter_count"))
    overlaid = items.where(F.substring("book_id", 4, 9).cast("long") % 2 == 0).select("book_id")
    return exports.manifest_rows(counts.withColumn("source_hash", F.sha2("book_id", 256)), overlaid, "standard").drop("created_at")


def _sql_json(sql: str) -> str:
    return f"CAST(to_json({sql}) AS VARCHAR)"


# Contents of three levels: parts of 25 chapters, groups of 5, chapters.
view(
    "v_contents",
    f"""SELECT book_id, n // 25 AS a, n % 25 // 5 AS b, n % 5 AS c, coalesce(nullif(title, ''), 'untitled') AS title, href FROM (
          SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY spine_index) - 1 AS n FROM v_chapters)""",
)
view(
    "v_nested",
    f"""SELECT book_id, '[' || string_agg(left(j, length(j) - 1) || ',"children":[' || kids || ']}}', ',' ORDER BY a) || ']' AS contents FROM (
          SELECT book_id, a, {_sql_json("{'label': 'Part ' || (a + 1), 'href': arg_min(href, b)}")} AS j,
            string_agg(left(j, length(j) - 1) || ',"children":[' || kids || ']}}', ',' ORDER BY b) AS kids FROM (
            SELECT book_id, a, b, arg_min(href, c) AS href, {_sql_json("{'label': 'Group ' || (b + 1), 'href': arg_min(href, c)}")} AS j,
              string_agg({_sql_json("{'label': title, 'href': href}")}, ',' ORDER BY c) AS kids FROM v_contents GROUP BY book_id, a, b)
          GROUP BY book_id, a) GROUP BY book_id""",
)


def contents(spark, folder):
    """Chapters of a book in parts and groups: (book_id, path, label, href) of all three levels."""
    from lectern.operators.prefix import numbered

    rows = numbered(base.chapters(spark, folder), ["book_id"], "spine_index", "n")
    a, b, c = (F.expr(f"cast({e} as int)") for e in ("n div 25", "n % 25 div 5", "n % 5"))
    title = F.when(F.col("title") == "", "untitled").otherwise(F.col("title"))
    leaves = rows.select("book_id", F.array(a, b, c).alias("path"), title.alias("label"), "href")
    groups = rows.where("n % 5 = 0").select(
        "book_id", F.array(a, b).alias("path"), F.concat(F.lit("Group "), (b + 1).cast("string")).alias("label"), "href"
    )
    parts = rows.where("n % 25 = 0").select(
        "book_id", F.array(a).alias("path"), F.concat(F.lit("Part "), (a + 1).cast("string")).alias("label"), "href"
    )
    return leaves.unionByName(groups).unionByName(parts)


@query(
    "book_ir",
    f"""SELECT book_id, CAST(0 AS BIGINT) AS section, 0 AS pos, 0 AS ord, {_sql_json("{'title': book_id || ' collected', 'identifier': 'urn:' || book_id, 'language': NULL::VARCHAR, 'package_version': '3.0'}")} AS json
          FROM (SELECT DISTINCT book_id FROM v_chapters)
        UNION ALL SELECT book_id, 1, section_index, 0, sha256({_sql_json("{'chapter_id': printf('chapter_%03d', section_index + 1), 'title': title, 'ranges': list(r ORDER BY r.spine_index)}")})
          FROM (SELECT book_id, section_index, title, {{'spine_index': spine_index, 'block_ids': list(block_id ORDER BY section_ord)}} AS r FROM v_section_blocks GROUP BY book_id, section_index, title, spine_index)
          GROUP BY book_id, section_index, title
        UNION ALL SELECT book_id, 2, 0, 0, contents FROM v_nested
        UNION ALL SELECT book_id, 3, spine_index, 0, {_sql_json("{'spine_index': spine_index, 'idref': 'doc-' || spine_index, 'href': href, 'linear': NOT is_noise}")} FROM v_chapters
        UNION ALL SELECT book_id, 4, spine_index, 0, sha256({_sql_json("{'spine_index': spine_index, 'href': href, 'title': title, 'block_count': block_count, 'visible_text': visible_text, 'content_hash': sha256(visible_text), 'first_block_id': first_block_id, 'last_block_id': last_block_id, 'is_noise': is_noise}")}) FROM v_chapter_rows
        UNION ALL SELECT book_id, 5, spine_index, ord, sha256({_sql_json("{'block_id': block_id, 'chapter_index': spine_index, 'order': ord, 'kind': 'paragraph', 'text': text, 'text_fingerprint': fp, 'heading_level': NULL::INTEGER, 'merged_from': []::VARCHAR[], 'footnote_id': NULL::VARCHAR, 'footnote_refs': []::VARCHAR[], 'referenced_by': []::VARCHAR[], 'image': NULL::VARCHAR, 'starts_chapter': false, 'ends_chapter': false, 'source_ref': {'chapter_href': href, 'spine_index': spine_index, 'node_id': ord, 'cfi': NULL::VARCHAR}}")}) FROM v_blocks""",
)
def book_ir(spark, folder):
    """Whole-book documents written as ordered parts, read back and compared whole; long parts by their hash."""
    from lectern.plans import queries_corpus, queries_sections
    from lectern.sinks import book_document

    path = scratch(spark)
    chapters = durable(corpus.chapter_rows(queries_corpus.normal_chapters(spark, folder)))
    listed = base.chapters(spark, folder)
    blocks = base.blocks(spark, folder)
    # Sections need no text beyond the labels: what is stored for them is narrow.
    spots = durable(blocks.select("book_id", "spine_index", "href", "ord", "block_id", F.substring("text", 1, 20).alias("text")))
    sections = queries_sections.built(spark, folder, spots)
    none = F.lit(None).cast("string")
    metadata = listed.select("book_id").distinct().select(
        "book_id", F.concat("book_id", F.lit(" collected")).alias("title"), F.concat(F.lit("urn:"), "book_id").alias("identifier"),
        none.alias("language"), F.lit("3.0").alias("package_version"),
    )
    spine = listed.select(
        "book_id", "spine_index", F.concat(F.lit("doc-"), F.col("spine_index").cast("string")).alias("idref"), "href",
        (~F.col("is_noise")).alias("linear"),
    )
    parts = book_document.document_parts(
        metadata, sections, section_operators.section_blocks(sections, spots), contents(spark, folder), spine, chapters, blocks
    )
    book_document.write_documents(parts, path)
    rows = book_document.read_documents(spark, path)
    return rows.withColumn("json", F.when(F.col("section").isin(1, 4, 5), F.sha2("json", 256)).otherwise(F.col("json")))


@query(
    "contents_by_path",
    """SELECT book_id, max(CASE WHEN a = 0 AND b = 0 AND c = 0 THEN title END) AS first_title, max(CASE WHEN a = 0 AND b = 0 AND c = 1 THEN href END) AS second_href,
         count(DISTINCT a) AS parts FROM v_contents GROUP BY book_id""",
)
def contents_by_path(spark, folder):
    """Nested contents as a variant: values at a path, and the number of parts."""
    from lectern.sinks import book_document

    nested = book_document.nested_contents(contents(spark, folder)).select("book_id", F.parse_json("contents").alias("v"))
    return nested.select(
        "book_id",
        F.expr("variant_get(v, '$[0].children[0].children[0].label', 'string')").alias("first_title"),
        F.expr("try_variant_get(v, '$[0].children[0].children[1].href', 'string')").alias("second_href"),
        F.size(F.expr("cast(v as array<variant>)")).cast("long").alias("parts"),
    )


@query(
    "chapter_analysis_files",
    """SELECT a.book_id, a.spine_index, a.chapter_id, rtrim(substring(first_text, 1, 80)) AS one_sentence, sha256(substring(joined, 1, 400)) AS deep_hash,
         CASE WHEN a.spine_index % 10 = 3 THEN '  ' ELSE substring(first_text, 1, 160) END AS short, 'Chapter ' || a.spine_index AS role_in_book,
         source_content_hash, array_to_string(key_ideas, '|') AS key_ideas, coalesce(r.refs, '') AS cited
       FROM v_analyses a LEFT JOIN (SELECT spine_index, string_agg(block_id || ':' || end_char || ':' || text_fingerprint, ',' ORDER BY ord) AS refs FROM v_ref_rows WHERE kind = 0 GROUP BY spine_index) r
         USING (spine_index)""",
)
def chapter_analysis_files(spark, folder):
    """Analyses of all chapters written, one document each, and read back: texts, hashes and citations."""
    path = scratch(spark)
    made = package.chapter_analyses(spark, folder).select(
        "book_id", "spine_index", "chapter_id", "summary", "source_content_hash", "key_ideas", "concepts"
    )
    exports.write_chapter_analyses(made, path)
    rows = spark.read.schema(made.schema).json(path)
    name = lambda r: F.concat_ws(":", r["block_id"], r["end_char"].cast("string"), r["text_fingerprint"])
    return rows.select(
        "book_id", "spine_index", "chapter_id", F.rtrim("summary.one_sentence").alias("one_sentence"), F.sha2("summary.deep", 256).alias("deep_hash"),
        F.col("summary.short").alias("short"), F.col("summary.role_in_book").alias("role_in_book"), "source_content_hash",
        F.array_join("key_ideas", "|").alias("key_ideas"),
        F.array_join(F.transform(F.col("concepts")[0]["source_refs"], name), ",").alias("cited"),
    )


def _stamped(df):
    """Schema of a book-level table as it is written."""
    return StructType([*df.schema.fields, StructField("schema_version", StringType()), StructField("source_hash", StringType())])


@query(
    "synthesis_documents",
    """SELECT *, '0.1' AS schema_version, sha256(book_id) AS source_hash FROM (
         SELECT book_id, 'concepts' AS document, concept_id AS id, name || '/' || importance || '/' || grounding AS content FROM v_concepts
         UNION ALL SELECT c.book_id, 'claims', claim_id, substring(r.text, 1, 60) || '/' || importance || '/' || grounding || '/' || depends_on FROM v_claims c
           JOIN v_ref_rows r ON r.spine_index = c.spine_index AND 'claim-' || r.spine_index || '-' || r.ord = c.claim_id
         UNION ALL SELECT book_id, 'entities', entity_id, n_refs || '/grounded' FROM v_entities
         UNION ALL SELECT book_id, 'checkpoints', 'checkpoint-' || spine_index, array_to_string(['a', 'b', 'c', 'd', 'e', 'f'][1:spine_index % 7], '') FROM v_analyses
         UNION ALL SELECT book_id, 'book_map', 'role-' || spine_index, 'Carries the argument.' FROM v_cover WHERE subject = 'role'
         UNION ALL SELECT book_id, 'recall_cards', id, kind FROM v_deck)""",
)
def synthesis_documents(spark, folder):
    """Six book-level documents written and read back, a row per object."""
    path = scratch(spark)
    analyses = package.stored_analyses(spark, folder)
    hashes = analyses.select("book_id").distinct().withColumn("source_hash", F.sha2("book_id", 256))
    named = lambda df, key: df.withColumn("id", F.col(key))
    roles = package.chapter_roles(analyses).withColumn("id", F.concat(F.lit("role-"), F.col("spine_index").cast("string")))
    documents = {
        "concepts": named(package.concepts(analyses), "concept_id"),
        "claims": named(package.claims(analyses), "claim_id"),
        "entities": named(package.entities(analyses), "entity_id"),
        "checkpoints": named(package.checkpoints(analyses), "checkpoint_id"),
        "book_map": roles,
        "recall_cards": grounding.recall_deck(package.checkpoints(analyses)),
    }
    exports.write_synthesis_documents(documents, hashes, "0.1", path)
    content = {
        "concepts": F.concat_ws("/", "name", F.col("importance").cast("string"), "grounding"),
        "claims": F.concat_ws("/", "claim", F.col("importance").cast("string"), "grounding", F.col("depends_on")[0]),
        "entities": F.concat_ws("/", F.size("appearances").cast("string"), "grounding"),
        "checkpoints": F.array_join("must_understand", ""),
        "book_map": F.col("role"),
        "recall_cards": F.col("kind"),
    }
    rows = [
        spark.read.schema(_stamped(df))
        .json(f"{path}/{name}")
        .select("book_id", F.lit(name).alias("document"), "id", content[name].alias("content"), "schema_version", "source_hash")
        for name, df in documents.items()
    ]
    return base.union_all(rows)


@query(
    "eval_report_files",
    "SELECT book_id, source_ref_count, error_count FROM v_report",
)
def eval_report_files(spark, folder):
    path = _eval_report(spark, folder)
    stats = spark.read.schema("book_id string, source_ref_count bigint").json(f"{path}/stats")
    issues = exports.read_eval_issues(spark, path, "book_id string, path string, code string")
    return stats.join(issues.groupBy("book_id").agg(F.count(F.lit(1)).alias("error_count")), "book_id")


def _eval_report(spark, folder):
    from lectern.plans import queries_grounding as qg

    path = scratch(spark)
    found = qg.resolved(spark, folder)
    unsupported = grounding.claims_without_evidence(found.analyses, package.claims(found.analyses))
    issues = durable(grounding.grounding_issues(found.checked, unsupported))
    exports.write_eval_report(durable(qg.report(spark, folder, found)), issues, path)
    return path


@query("eval_report_issues", "SELECT book_id, path, code FROM v_issues")
def eval_report_issues(spark, folder):
    """Every issue of the written reports as it is read back."""
    return exports.read_eval_issues(spark, _eval_report(spark, folder), "book_id string, path string, code string")


@query(
    "benchmark_report",
    """SELECT count(*) AS attempts, count(*) FILTER (s.status = 'completed') AS completed, count(*) FILTER (passed) AS structural_passes, count(*) FILTER (len(hard_failures) > 0) AS hard_failures,
         count(*) FILTER (semantic_state = 'evaluated') AS semantic_evaluated, count(*) FILTER (task_success) AS task_successes, CAST(sum(call_count) AS BIGINT) AS calls,
         CASE WHEN bool_or(len(hard_failures) > 0 OR task_success IS FALSE) THEN 'fail' ELSE 'inconclusive' END AS quality
       FROM v_full s JOIN v_trials t USING (attempt_id)""",
)
def benchmark_report(spark, folder):
    return exports.benchmark_report(qs.full_scores(spark, folder), suite_data.trials(spark, folder))


@query(
    "benchmark_report_groups",
    """SELECT suite, language, count(*) AS attempts, count(*) FILTER (s.status = 'completed') AS completed, count(*) FILTER (passed) AS structural_passes,
         count(*) FILTER (len(hard_failures) > 0) AS hard_failures, count(*) FILTER (semantic_state = 'evaluated') AS semantic_evaluated, count(*) FILTER (task_success) AS task_successes,
         CAST(sum(call_count) AS BIGINT) AS calls, CASE WHEN bool_or(len(hard_failures) > 0 OR task_success IS FALSE) THEN 'fail' ELSE 'inconclusive' END AS quality
       FROM v_full s JOIN v_trials t USING (attempt_id) JOIN (SELECT case_id, suite, language FROM v_cases) c ON c.case_id = t.case_id GROUP BY suite, language""",
)
def benchmark_report_groups(spark, folder):
    """The report for each suite and language."""
    trials = suite_data.trials(spark, folder).join(suite_data.cases(spark, folder).select("case_id", "suite", "language"), "case_id")
    return exports.benchmark_report(qs.full_scores(spark, folder), trials, "suite", "language")


@query(
    "export_summary",
    """SELECT count(*) AS attempts, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (passed) AS structural_passes, count(*) FILTER (len(hard_failures) > 0) AS hard_failures,
         CASE WHEN bool_or(len(hard_failures) > 0 OR task_success IS FALSE) THEN 'fail' ELSE 'inconclusive' END AS quality FROM v_full""",
)
def export_summary(spark, folder):
    return exports.export_summary(exports.benchmark_report(qs.full_scores(spark, folder), suite_data.trials(spark, folder)))


@query(
    "report_markdown",
    """SELECT attempt_id, '| ' || attempt_id || ' | ' || status || ' | ' || coalesce(CAST(passed AS VARCHAR), 'unknown') || ' | ' || coalesce(CAST(task_success AS VARCHAR), 'unknown') || ' |' AS line FROM v_full""",
)
def report_markdown(spark, folder):
    return exports.report_markdown(qs.full_scores(spark, folder))


@query(
    "artifact_bytes",
    "SELECT source AS book_id, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source",
)
def artifact_bytes(spark, folder):
    """Documents as the artifacts of their source."""
    from lectern.sources import sizes

    docs = base.table(spark, folder, "documents").select(F.col("source").alias("book_id"), F.col("text").alias("content"))
    return sizes.artifact_bytes(docs)


@query(
    "reader_event_files",
    """SELECT event_id, session_id, book_id, ord, char_offset, mode FROM (SELECT *, 'src' || (user_id % 20) AS book_id FROM v_events)""",
)
def reader_event_files(spark, folder):
    """The reader feed written as JSON lines and read back with its schema."""
    path = scratch(spark)
    feed = reader.events(spark, folder).select("event_id", "session_id", "book_id", "ord", "char_offset", "mode")
    feed.write.json(path)
    return files.read_reader_events(spark, path, feed.schema)


FILES_A_FOLDER = 512  # a task of the reader takes one such folder or more


def _books(spark, folder):
    """Every chapter as an EPUB file in the shared folder, one page per block; odd ones with a navigation of their own."""
    from lectern.plans.epub_rows import write_archives
    from lectern.sources import epub

    path = scratch(spark)
    items = corpus.chapter_items(base.chapters_raw(spark, folder)).where("size(items) > 0")
    write_archives(
        items.select(
            F.concat(F.lit("doc-"), F.col("spine_index").cast("string")).alias("name"),
            F.transform("items", lambda b: b["text"]).alias("texts"),
            (F.col("spine_index") % 2 == 1).alias("own_navigation"),
        ),
        path if "://" in path else "file://" + path.removeprefix("file:"),
        max(1, -(-base.table(spark, folder, "documents").count() // FILES_A_FOLDER)),
    )
    epub.register(spark)
    rows = spark.read.format("epub").load(path if "://" in path else "file://" + path.removeprefix("file:"))
    return rows.withColumn("doc_id", F.regexp_extract("path", r"doc-(\d+)\.epub$", 1).cast("long"))


view("v_pages", "SELECT spine_index AS doc_id, row_number() OVER (PARTITION BY spine_index ORDER BY ord) - 1 AS item, text FROM v_blocks")


@query("epub_documents", "SELECT doc_id, item, sha256(text) AS text_hash, CAST(NULL AS VARCHAR) AS error FROM v_pages")
def epub_documents(spark, folder):
    """EPUB files read by the data source; the text of every page by its hash."""
    rows = _books(spark, folder).where("is_nav = false or error is not null")
    body = F.regexp_extract("html", "(?s)<body>(.*)</body>", 1)
    return rows.select(
        "doc_id", F.col("spine_index").alias("item"), F.sha2(T.decode_entities(T.strip_markup(body)), 256).alias("text_hash"), "error"
    )


@query(
    "package_toc",
    "SELECT doc_id, item AS pos, item || ': ' || rtrim(substring(text, 1, 20)) AS label, 'c' || item || '.xhtml' AS href FROM v_pages",
)
def package_toc(spark, folder):
    """Contents of EPUB files, from nav documents where there are any and from the packages' navigation elsewhere."""
    found = markup.package_toc(_books(spark, folder))
    return found.select(F.regexp_extract("book", r"doc-(\d+)\.epub$", 1).cast("long").alias("doc_id"), "pos", "label", "href")
