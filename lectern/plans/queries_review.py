"""Versions, metrics, incremental compile and analyzer queries."""

import json

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import analysis, corpus, grounding, packages, review
from lectern.plans import base, package
from lectern.plans import queries_grounding as qg
from lectern.plans.registry import query, view
from lectern.session import durable, spread

view(
    "v_edits",
    """SELECT 'concept' AS kind, 'concept-' || conv_id AS id, turn AS seq, text AS value, 'src' || (conv_id % 20) AS book_id FROM conversations WHERE role = 'assistant'""",
)


def concept_values(spark, folder, analyses=None):
    analyses = package.chapter_analyses(spark, folder) if analyses is None else analyses
    return package.concepts(analyses).select(
        F.lit("concept").alias("kind"), F.col("concept_id").alias("id"), F.col("name").alias("value"), "book_id"
    )


def edits(spark, folder):
    """Assistant turns as successive edits of the concept with the conversation's number."""
    return base.table(spark, folder, "conversations").where("role = 'assistant'").select(
        F.lit("concept").alias("kind"),
        F.concat(F.lit("concept-"), F.col("conv_id").cast("string")).alias("id"),
        F.col("turn").alias("seq"),
        F.lit("editor").alias("analyzer"),
        F.col("text").alias("value"),
    )


view(
    "v_history",
    """SELECT 'concept' AS kind, c.concept_id AS id, 0 AS revision, c.name AS value, c.concept_id NOT IN (SELECT id FROM v_edits) AS is_latest, c.book_id FROM v_concepts c
       UNION ALL SELECT e.kind, e.id, row_number() OVER (PARTITION BY e.id ORDER BY e.seq), e.value, lead(e.seq) OVER (PARTITION BY e.id ORDER BY e.seq) IS NULL, c.book_id
       FROM v_edits e JOIN v_concepts c ON c.concept_id = e.id""",
)


@query("version_history", "SELECT kind, id, revision, value, is_latest FROM v_history")
def version_history(spark, folder):
    history = review.version_history(concept_values(spark, folder).drop("book_id"), edits(spark, folder))
    return history.select("kind", "id", "revision", "value", "is_latest")


@query("effective_documents", "SELECT kind, id, value, revision FROM v_history WHERE is_latest")
def effective_documents(spark, folder):
    return review.effective_documents(concept_values(spark, folder).drop("book_id"), edits(spark, folder))


@query(
    "json_diff",
    """SELECT spine_index, p AS path, l AS "left", r AS "right" FROM (
         SELECT spine_index, '$.lines[' || i || ']' AS p, CASE WHEN i < len(a) THEN a[i + 1] END AS l0, CASE WHEN i < len(b) THEN b[i + 1] END AS r0 FROM (
           SELECT *, unnest(range(0, greatest(len(a), len(b)))) AS i FROM (
             SELECT spine_index, list(ord ORDER BY ord) AS a, list(ord ORDER BY ord) FILTER (ord % 3 <> 1) AS b FROM v_blocks GROUP BY spine_index)))
       , LATERAL (SELECT coalesce(CAST(l0 AS VARCHAR), 'null') AS l, coalesce(CAST(r0 AS VARCHAR), 'null') AS r) WHERE l <> r
       UNION ALL SELECT spine_index, '$.meta.n', CAST(count(*) AS VARCHAR), 'null' FROM v_blocks GROUP BY spine_index""",
)
def json_diff(spark, folder):
    """Line numbers of a chapter against the same list with every third one missing."""
    items = corpus.chapter_items(base.chapters_raw(spark, folder)).where("size(items) > 0")
    all_lines = F.transform("items", lambda b: b["ord"])
    some = F.filter(all_lines, lambda o: o % 3 != 1)
    pairs = items.select(
        "spine_index",
        F.to_json(F.struct(all_lines.alias("lines"), F.struct(F.size("items").alias("n")).alias("meta"))).alias("left_json"),
        F.to_json(F.struct(some.alias("lines"), F.create_map(F.lit("m"), F.lit(None).cast("int")).alias("meta"))).alias("right_json"),
    )
    return review.json_diff(pairs, "spine_index", limit=1_000_000).select("spine_index", "path", "left", "right")


def objects(analyses):
    """Concepts and claims with whether they cite anything; every fourth book declares no claims."""
    number = F.substring("book_id", 4, 9).cast("long")
    concepts = package.concepts(analyses).select("book_id", F.lit("concept").alias("kind"), (F.size("appearances") > 0).alias("grounded"))
    claims = package.claims(analyses).where(number % 4 != 1).select("book_id", F.lit("claim").alias("kind"), (F.size("evidence") > 0).alias("grounded"))
    return concepts.unionByName(claims)


def metric_rows(spark, folder, report, analyses):
    chapters = corpus.chapter_items(base.chapters_raw(spark, folder)).withColumn("block_count", F.size("items"))
    number = F.substring("book_id", 4, 9).cast("long")
    waivers = analyses.select("book_id").distinct().where(number % 3 == 0).select(
        "book_id", F.lit("claim_grounding").alias("metric"), F.when(number % 2 == 0, "").otherwise("no claims made").alias("reason")
    )
    return review.eval_metrics(chapters, report, objects(analyses), waivers)


def reported_metrics(spark, folder):
    """(metrics, report) from analyses that are derived once."""
    found = qg.resolved(spark, folder)
    report = durable(qg.report(spark, folder, found))
    return metric_rows(spark, folder, report, found.analyses), report


view(
    "v_metric_parts",
    """SELECT c.book_id, CAST(substring(c.book_id, 4) AS BIGINT) AS num, c.readable, c.parsed, r.analyzed_chapter_count, r.source_ref_count, r.error_count, k.claims, k.grounded_claims, n.concepts, n.grounded_concepts
       FROM (SELECT c.book_id, count(*) AS readable, count(*) FILTER (title <> '' AND f.spine_index IS NOT NULL) AS parsed FROM v_chapters c
             LEFT JOIN (SELECT DISTINCT spine_index FROM v_blocks) f USING (spine_index) WHERE NOT is_noise GROUP BY ALL) c
       JOIN v_report r USING (book_id)
       LEFT JOIN (SELECT book_id, count(*) AS claims, count(*) FILTER (has_evidence) AS grounded_claims FROM v_claims GROUP BY ALL) k USING (book_id)
       LEFT JOIN (SELECT book_id, count(*) AS concepts, count(*) FILTER (n_refs > 0) AS grounded_concepts FROM v_concepts GROUP BY ALL) n USING (book_id)""",
)
view(
    "v_metrics",
    """SELECT book_id, metric, value, CASE WHEN value IS NULL THEN CASE WHEN metric = 'claim_grounding' AND num % 3 = 0 AND num % 2 = 1 THEN 'not_applicable' ELSE 'missing_required' END ELSE 'evaluated' END AS state,
         CASE WHEN metric = 'claim_grounding' AND num % 3 = 0 THEN CASE WHEN num % 2 = 0 THEN 'reason_required' WHEN value IS NOT NULL THEN 'existing_output' END END AS waiver_error FROM (
         SELECT book_id, num, 'parse_quality' AS metric, parsed * 10000 // readable AS value FROM v_metric_parts
         UNION ALL SELECT book_id, num, 'source_ref_validity', greatest(source_ref_count - error_count, 0) * 10000 // source_ref_count FROM v_metric_parts
         UNION ALL SELECT book_id, num, 'chapter_coverage', analyzed_chapter_count * 10000 // readable FROM v_metric_parts
         UNION ALL SELECT book_id, num, 'claim_grounding', CASE WHEN num % 4 <> 1 THEN grounded_claims * 10000 // claims END FROM v_metric_parts
         UNION ALL SELECT book_id, num, 'concept_grounding', grounded_concepts * 10000 // concepts FROM v_metric_parts)""",
)


@query("eval_metrics", "SELECT book_id, metric, state, value, waiver_error FROM v_metrics")
def eval_metrics(spark, folder):
    return reported_metrics(spark, folder)[0]


@query(
    "metric_regressions",
    """SELECT book_id, metric, 2 AS run, regressed FROM (SELECT book_id, metric, value IS NOT NULL AND (nv IS NULL OR nv < value) AS regressed FROM (
         SELECT *, CASE WHEN num % 5 <> 2 THEN value - (num % 3) * 100 END AS nv FROM (SELECT *, CAST(substring(book_id, 4) AS BIGINT) AS num FROM v_metrics)))
       UNION ALL SELECT book_id, metric, 1, false FROM v_metrics""".replace("2 AS run", "CAST(2 AS BIGINT) AS run"),
)
def metric_regressions(spark, folder):
    """A second run that lost up to 200 points, and all values of some books."""
    first = durable(reported_metrics(spark, folder)[0].select("book_id", "metric", "state", "value"))
    number = F.substring("book_id", 4, 9).cast("long")
    second = first.withColumn("value", F.when(number % 5 != 2, F.col("value") - (number % 3) * 100))
    run = lambda df, n: df.withColumn("run", F.lit(n).cast("long"))
    return review.metric_regressions(run(first, 1).unionByName(run(second, 2))).select("book_id", "metric", "run", "regressed")


view(
    "v_semantic",
    """SELECT book_id, CASE WHEN num % 5 = 0 THEN 'missing_reviewer' WHEN num % 7 = 1 THEN 'stale_analysis' WHEN num % 11 = 2 THEN 'dimensions' END AS rejected,
         CASE WHEN num % 3 = 0 THEN 2 * 10000 // 3 ELSE 10000 END AS score FROM (SELECT DISTINCT book_id, CAST(substring(book_id, 4) AS BIGINT) AS num FROM v_analyses)""",
)


def semantic(spark, folder):
    number = F.substring("book_id", 4, 9).cast("long")
    books = base.chapters(spark, folder).where("not is_noise").select("book_id").distinct()
    current = books.select("book_id", F.sha2("book_id", 256).alias("analysis_fingerprint"), F.lit("n").alias("annotations_fingerprint"))
    reviews = current.select(
        "book_id",
        F.when(number % 5 == 0, "").otherwise("reader").alias("reviewer"),
        F.when(number % 7 == 1, "old").otherwise(F.col("analysis_fingerprint")).alias("analysis_fingerprint"),
        "annotations_fingerprint",
    )
    dims = F.array(*[F.lit(d) for d in review.SEMANTIC_DIMENSIONS])
    checks = books.select("book_id", F.posexplode(F.when(number % 11 == 2, F.slice(dims, 1, 2)).otherwise(dims)).alias("d", "dimension")).select(
        "book_id", "dimension", F.lit("e").alias("expected"), F.lit("o").alias("observed"), (~((number % 3 == 0) & (F.col("d") == 1))).alias("passed")
    )
    return review.bind_semantic_review(reviews, checks, current)


@query(
    "bind_semantic_review",
    "SELECT book_id, rejected, CASE WHEN rejected IS NULL THEN CAST(score AS BIGINT) END AS semantic_basis_points FROM v_semantic",
)
def bind_semantic_review(spark, folder):
    return semantic(spark, folder)


@query(
    "evaluate_packages",
    """SELECT book_id, r.error_count = 0 AS structural_valid, r.error_count = 0 AND NOT m.missing AS valid, r.error_count = 0 AND NOT m.missing AND s.rejected IS NULL AND s.score = 10000 AS beta_ready,
         m.low + r.error_count + CASE WHEN summary_coverage_basis_points < 5000 THEN 1 ELSE 0 END AS findings, m.regressions, m.waiver_errors, m.fingerprint
       FROM v_report r JOIN (SELECT book_id, bool_or(state = 'missing_required') AS missing, count(*) FILTER (state = 'missing_required' OR value < 8000) AS low, count(waiver_error) AS waiver_errors,
           count(*) FILTER (value IS NOT NULL AND CAST(substring(book_id, 4) AS BIGINT) % 5 = 2) AS regressions,
           sha256(string_agg(metric || '=' || state || ':' || coalesce(CAST(value AS VARCHAR), 'null'), ';' ORDER BY metric)) AS fingerprint FROM v_metrics GROUP BY book_id) m USING (book_id)
       LEFT JOIN v_semantic s USING (book_id)""",
)
def evaluate_packages(spark, folder):
    """Against a run before in which every fifth book had one point more."""
    now, report = reported_metrics(spark, folder)
    now = durable(now)
    more = F.when(F.substring("book_id", 4, 9).cast("long") % 5 == 2, 1).otherwise(0)
    return review.evaluate_packages(now, report, semantic(spark, folder), now.withColumn("value", F.col("value") + more))


view(
    "v_concept_faults",
    "SELECT book_id, id, count(*) AS n FROM v_synthesis_issues WHERE kind = 'concept' GROUP BY ALL",
)


@query(
    "apply_edits",
    """SELECT concept_id AS edit_id, concat_ws(',', CASE WHEN spine_index % 12 = 5 THEN 'unknown_document' END, CASE WHEN importance > 100 AND spine_index % 2 = 1 THEN 'score_out_of_range' END,
         CASE WHEN grounding = 'grounded' AND n_refs = 0 THEN 'grounded_without_refs' END, CASE WHEN coalesce(bad, false) THEN 'violates_grounding' END,
         CASE WHEN coalesce(t.n, 0) > CASE WHEN spine_index % 12 = 5 THEN 0 ELSE coalesce(o.n, 0) END THEN 'package_invalid' END) AS rejected
       FROM v_concepts c LEFT JOIN (SELECT r.spine_index, bool_or(b.block_id IS NULL OR r.end_char > b.n_chars OR r.start_char >= r.end_char OR r.text_fingerprint <> b.fp) AS bad
         FROM v_ref_rows r LEFT JOIN v_blocks b USING (block_id) WHERE r.kind = 0 GROUP BY ALL) USING (spine_index)
       LEFT JOIN v_concept_faults o ON o.book_id = c.book_id AND o.id = c.concept_id LEFT JOIN (SELECT book_id, sum(n) AS n FROM v_concept_faults GROUP BY ALL) t ON t.book_id = c.book_id""",
)
def apply_edits(spark, folder):
    """Every concept resubmitted as an edit, half of the scores mended; some name a concept that does not exist."""
    concepts = package.concepts(package.stored_analyses(spark, folder))
    even = F.col("spine_index") % 2 == 0
    proposed = concepts.select(
        F.col("concept_id").alias("edit_id"),
        F.lit("concept").alias("kind"),
        "book_id",
        F.when(F.col("spine_index") % 12 == 5, "concept-x").otherwise(F.col("concept_id")).alias("id"),
        F.when(even, F.least("importance", F.lit(100))).otherwise(F.col("importance")).alias("importance"),
        "grounding",
        F.col("appearances").alias("refs"),
    )
    declared = concepts.select("book_id", F.lit("concept").alias("kind"), F.col("concept_id").alias("id"))
    faults = qg.synthesis(package.stored_analyses(spark, folder)).where("kind = 'concept'")
    return review.apply_edits(proposed, base.blocks(spark, folder), declared, faults).select("edit_id", "rejected")


@query(
    "golden_snapshots",
    """SELECT 'g' || spine_index AS golden_id, coalesce(e.value, c.title) AS annotation, CASE WHEN c.title = '' THEN 'blank_label' WHEN c.spine_index % 8 = 3 THEN 'other_source' END AS error
       FROM v_chapters c LEFT JOIN (SELECT id, arg_max(value, seq) AS value FROM v_edits GROUP BY ALL) e ON e.id = 'concept-' || c.spine_index""",
)
def golden_snapshots(spark, folder):
    """A golden per chapter, annotated again by the conversation with its number."""
    rows = base.chapters(spark, folder)
    text = F.col("spine_index").cast("string")
    goldens = rows.select(
        F.concat(F.lit("g"), text).alias("golden_id"),
        F.col("href").alias("book_id"),
        F.col("title").alias("label"),
        F.col("title").alias("annotation"),
        F.when(F.col("spine_index") % 8 == 3, "old").otherwise(F.sha2("href", 256)).alias("source_hash"),
    )
    notes = edits(spark, folder).select(
        F.concat(F.lit("g"), F.substring_index("id", "-", -1)).alias("golden_id"), F.col("value").alias("annotation"), "seq"
    )
    sources = rows.select(F.col("href").alias("book_id"), F.sha2("href", 256).alias("source_hash"))
    return review.golden_snapshots(goldens, notes, sources).select("golden_id", "annotation", "error")


@query(
    "studio_snapshot",
    """SELECT r.book_id, analyzed_chapter_count, source_ref_count, error_count, coalesce(v.versions, 0) AS versions, coalesce(v.edited, 0) AS edited_documents FROM v_report r
       LEFT JOIN (SELECT book_id, count(*) AS versions, count(*) FILTER (is_latest) AS edited FROM v_history WHERE revision > 0 GROUP BY ALL) v USING (book_id)""",
)
def studio_snapshot(spark, folder):
    found = qg.resolved(spark, folder)
    values = durable(concept_values(spark, folder, found.analyses))
    history = review.version_history(values.drop("book_id"), edits(spark, folder)).join(values.select("id", "book_id"), "id")
    return review.studio_snapshot(durable(qg.report(spark, folder, found)), history)


# --- analysis ----------------------------------------------------------------

view(
    "v_sentences",
    """SELECT spine_index AS book_id, ord AS spine_index, generate_subscripts(p, 1) - 1 AS ord, unnest(p) AS text,
         'sentence-' || (generate_subscripts(p, 1) - 1) AS block_id FROM (
         SELECT spine_index, ord, string_split(text, '. ') AS p FROM v_blocks)""",
)
view(
    "v_sentence_terms",
    f"SELECT book_id, spine_index, ord, unnest({base.sql_terms('text')}) AS term FROM v_sentences",
)
view(
    "v_prior",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, for_chapter ORDER BY score DESC, spine_index, ord) AS rank FROM (
         SELECT p.book_id, q.spine_index AS for_chapter, p.spine_index, p.ord, CAST(sum(100000 // (q.df + 1)) AS BIGINT) AS score
         FROM v_sentence_terms p JOIN (
           SELECT a.book_id, a.spine_index, a.term, count(*) AS df FROM (SELECT DISTINCT book_id, spine_index, term FROM v_sentence_terms) a
           JOIN v_sentence_terms b ON b.book_id = a.book_id AND b.term = a.term AND b.spine_index < a.spine_index GROUP BY ALL) q
         ON q.book_id = p.book_id AND q.term = p.term AND p.spine_index < q.spine_index GROUP BY ALL) WHERE score > 0) WHERE rank <= 8""",
)


def sentences(spark, folder):
    """Documents as books, lines as chapters, sentences as blocks."""
    rows = base.blocks(spark, folder).select("spine_index", "ord", F.posexplode(F.split("text", r"\. ")).alias("pos", "text"))
    return rows.select(
        F.col("spine_index").alias("book_id"), F.col("ord").alias("spine_index"), F.col("pos").cast("long").alias("ord"), "text",
        F.format_string("sentence-%d", "pos").alias("block_id"),
    )


@query("prior_context", "SELECT book_id, for_chapter, spine_index, ord, score, rank FROM v_prior")
def prior_context(spark, folder):
    return analysis.prior_context(sentences(spark, folder)).select("book_id", "for_chapter", "spine_index", "ord", "score", "rank")


@query(
    "chapter_requests",
    """SELECT b.spine_index AS book_id, b.ord AS spine_index, len(string_split(b.text, '. ')) AS n_blocks, row_number() OVER (PARTITION BY b.spine_index ORDER BY b.ord) - 1 AS n_prior,
         sha256(b.text) AS blocks_hash, sha256(coalesce(x.joined, '')) AS excerpts_hash, CAST(16 AS BIGINT) AS max_objects
       FROM v_blocks b LEFT JOIN (SELECT book_id, for_chapter, string_agg(s.block_id || '@' || p.spine_index || ':' || s.text, chr(10) ORDER BY p.rank) AS joined
         FROM v_prior p JOIN v_sentences s USING (book_id, spine_index, ord) GROUP BY ALL) x ON x.book_id = b.spine_index AND x.for_chapter = b.ord""",
)
def chapter_requests(spark, folder):
    chapters = base.blocks(spark, folder).select(
        F.col("spine_index").alias("book_id"), F.col("ord").alias("spine_index"), F.substring("text", 1, 20).alias("title"), F.split("text", r"\. ").alias("blocks")
    )
    rows = sentences(spark, folder)
    made = analysis.chapter_requests(analysis.prior_context(rows, beside=chapters), None, rows, profile="standard")
    line = lambda x: F.concat(x["block_id"], F.lit("@"), x["from_chapter"].cast("string"), F.lit(":"), x["text"])
    return made.select(
        "book_id",
        "spine_index",
        F.size("blocks").cast("long").alias("n_blocks"),
        F.col("prior_chapters").alias("n_prior"),
        F.sha2(F.array_join("blocks", ". "), 256).alias("blocks_hash"),
        F.sha2(F.array_join(F.transform("prior_excerpts", line), "\n"), 256).alias("excerpts_hash"),
        "max_objects",
    )


@query(
    "request_contents",
    """SELECT c.book_id, c.spine_index, n.contents AS table_of_contents, row_number() OVER (PARTITION BY c.book_id ORDER BY c.spine_index) - 1 AS n_prior
       FROM (SELECT DISTINCT book_id, spine_index FROM v_blocks) c JOIN v_nested n USING (book_id)""",
)
def request_contents(spark, folder):
    """Requests of all chapters with the nested contents of their book."""
    from lectern.plans import queries_io
    from lectern.sinks import book_document

    blocks = durable(base.blocks(spark, folder))
    chapters = blocks.groupBy("book_id", "spine_index").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("b")).select(
        "book_id", "spine_index", F.lit("").alias("title"), F.transform("b", lambda x: x["text"]).alias("blocks")
    )
    nested = book_document.nested_contents(queries_io.contents(spark, folder))
    none = blocks.select("book_id", F.col("spine_index").alias("for_chapter"), "spine_index", "ord", F.lit(1).alias("rank")).where("false")
    made = analysis.chapter_requests(chapters, none, blocks, profile="standard", contents=nested)
    return made.select("book_id", "spine_index", "table_of_contents", F.col("prior_chapters").alias("n_prior"))


view(
    "v_changed",
    """SELECT DISTINCT c.book_id, c.spine_index FROM v_chapter_cites c LEFT JOIN v_blocks b ON b.book_id = c.book_id AND b.block_id = c.block_id
       WHERE b.block_id IS NULL OR c.end_char > b.n_chars OR c.start_char >= c.end_char OR c.text_fingerprint <> b.fp""",
)


@query(
    "chapters_to_analyze",
    """SELECT a.book_id, a.spine_index FROM v_analyses a WHERE a.spine_index % 6 = 0 OR a.spine_index % 8 = 1 OR a.spine_index % 10 = 3
         OR a.spine_index IN (SELECT spine_index FROM v_changed)
         OR a.spine_index IN (SELECT spine_index FROM v_ref_rows WHERE kind = 1 AND h % 5 = 0)""",
)
def chapters_to_analyze(spark, folder):
    """Saved analyses of which some are of another text, profile or no longer valid."""
    analyses = package.chapter_analyses(spark, folder)
    chapters = analyses.select("book_id", "spine_index", "chapter_id", F.col("source_content_hash").alias("content_hash"))
    s = F.col("spine_index")
    saved = analyses.select(
        "book_id",
        "spine_index",
        "chapter_id",
        F.lit("1").alias("schema_version"),
        F.when(s % 8 == 1, "basic").otherwise("standard").alias("analysis_profile"),
        F.when(s % 6 == 0, "old").otherwise(F.col("source_content_hash")).alias("source_content_hash"),
        "summary",
    )
    resolved = grounding.resolve_refs(grounding.chapter_citations(analyses), base.blocks(spark, folder))
    bare = analyses.where(F.exists("claims", lambda c: F.size(c["evidence"]) == 0)).select("book_id", "spine_index")
    invalid = resolved.where("size(codes) > 0").select("book_id", F.col("max_chapter").alias("spine_index")).unionByName(bare)
    return analysis.chapters_to_analyze(chapters, saved, invalid, profile="standard", version="1").select("book_id", "spine_index")


@query(
    "analysis_key",
    """SELECT spine_index, sha256('{"source_hash":"' || sha256(text) || '","profile":"standard","analyzed_through":null}') AS analysis_key FROM v_chapters""",
)
def analysis_key(spark, folder):
    rows = base.chapters_raw(spark, folder).select(
        "spine_index",
        F.sha2("text", 256).alias("source_hash"),
        F.lit("standard").alias("profile"),
        F.lit(None).cast("long").alias("analyzed_through"),
    )
    return analysis.analysis_key(rows, ["source_hash", "profile", "analyzed_through"]).select("spine_index", "analysis_key")


@query(
    "profile_settings",
    """SELECT spine_index, CASE spine_index % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 END::BIGINT AS max_objects,
         CASE spine_index % 4 WHEN 0 THEN 'Be concise:' WHEN 1 THEN 'Balance coverage' WHEN 2 THEN 'Be comprehensive:' END AS starts FROM v_chapters""",
)
def profile_settings(spark, folder):
    s = F.col("spine_index")
    rows = base.chapters(spark, folder).select(
        "spine_index", F.when(s % 4 == 0, "basic").when(s % 4 == 1, "standard").when(s % 4 == 2, "deep").otherwise("other").alias("profile")
    )
    return analysis.profile_settings(rows).select(
        "spine_index", "max_objects", F.substring_index("instruction", " ", 2).alias("starts")
    )


@query("generated_rules", "SELECT spine_index, CASE WHEN spine_index % 10 = 3 THEN 'summary.short' ELSE '' END AS issues FROM v_analyses")
def generated_rules(spark, folder):
    return analysis.generated_issues(package.chapter_analyses(spark, folder)).select(
        "spine_index", F.array_join("issues", ",").alias("issues")
    )


@query(
    "synthesis_requests",
    """SELECT b.book_id, count(a.spine_index) AS chapters, CASE WHEN count(a.spine_index) = 0 THEN 'no_chapter_analyses' END AS error
       FROM (SELECT DISTINCT book_id FROM v_chapters) b LEFT JOIN v_analyses a USING (book_id) GROUP BY ALL""",
)
def synthesis_requests(spark, folder):
    made = analysis.synthesis_requests(base.chapters(spark, folder).select("book_id").distinct(), package.chapter_analyses(spark, folder))
    return made.select("book_id", "chapters", "error")


@query(
    "synthesis_chapters",
    """SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY spine_index) - 1 AS place, spine_index, chapter_id, sha256(substring(joined, 1, 400)) AS deep_hash,
         array_to_string(key_ideas, '|') AS key_ideas, source_content_hash FROM v_analyses""",
)
def synthesis_chapters(spark, folder):
    """Every analysis that a book's synthesis request refers to, read back from its JSON."""
    made = analysis.synthesis_chapters(package.stored_analyses(spark, folder))
    doc = F.from_json("analysis", "summary struct<deep:string>, key_ideas array<string>, source_content_hash string")
    return made.withColumn("d", doc).select(
        "book_id", "place", "spine_index", "chapter_id", F.sha2("d.summary.deep", 256).alias("deep_hash"),
        F.array_join("d.key_ideas", "|").alias("key_ideas"), "d.source_content_hash",
    )


@query(
    "earlier_chapters",
    "SELECT spine_index AS book_id, row_number() OVER (PARTITION BY spine_index ORDER BY ord) - 1 AS place, ord AS spine_index, substring(text, 1, 20) AS title FROM v_blocks",
)
def earlier_chapters(spark, folder):
    """The list of chapters that analysis requests refer to by place."""
    chapters = base.blocks(spark, folder).select(
        F.col("spine_index").alias("book_id"), F.col("ord").alias("spine_index"), F.substring("text", 1, 20).alias("title")
    )
    return analysis.earlier_chapters(chapters).select("book_id", "place", "spine_index", "title")


@query(
    "registration_analysis",
    """SELECT spine_index, 'Nothing has been written about ' || CASE WHEN title = '' THEN printf('chapter_%03d', spine_index + 1) ELSE title END || ' yet.' AS short,
         'Source-only baseline: no precomputed interpretation.' AS source_only FROM v_chapters WHERE NOT is_noise""",
)
def registration_analysis(spark, folder):
    rows = base.chapters(spark, folder).where("not is_noise").withColumn("chapter_id", T.chapter_id(F.col("spine_index")))
    made = analysis.registration_analysis(rows).withColumn("short", F.col("summary.short")).drop("summary")
    return analysis.source_only_analysis(made).select("spine_index", "short", F.col("summary.short").alias("source_only"))


@query(
    "extract_answer",
    """SELECT spine_index, sha256(string_agg(text, chr(10) ORDER BY ord)) AS answer_hash FROM (SELECT spine_index, text, min(ord) AS ord FROM v_blocks GROUP BY ALL) GROUP BY spine_index""",
)
def extract_answer(spark, folder):
    items = corpus.chapter_items(base.chapters_raw(spark, folder)).where("size(items) > 0")
    context = items.select("spine_index", F.transform("items", lambda b: b["text"]).alias("texts"))
    return analysis.extract_answer(context).select("spine_index", F.sha2("answer", 256).alias("answer_hash"))


def first_words(request):
    """Plug-in analyzer used by the query: the first words of a chapter, or a refusal."""
    words = request["text"].split()
    if len(words) < 3:
        raise ValueError("too short")
    return {"summary": {"one_sentence": words[0], "short": words[1], "deep": " ".join(words[:3]), "role_in_book": request["role"]}}


@query(
    "analyze",
    """SELECT spine_index, CASE WHEN n < 3 THEN 'failed' WHEN spine_index % 9 = 0 THEN 'invalid' ELSE 'completed' END AS status,
         CASE WHEN n < 3 THEN 'too short' WHEN spine_index % 9 = 0 THEN 'summary.role_in_book' END AS error FROM (
         SELECT spine_index, len(string_split(string_agg(text, ' ' ORDER BY ord), ' ')) AS n FROM v_blocks GROUP BY spine_index)""",
)
def analyze(spark, folder):
    items = corpus.chapter_items(base.chapters_raw(spark, folder)).where("size(items) > 0")
    request = F.to_json(
        F.struct(
            F.array_join(F.transform("items", lambda b: b["text"]), " ").alias("text"),
            F.when(F.col("spine_index") % 9 == 0, " ").otherwise("part").alias("role"),
        )
    )
    rows = items.select("spine_index", request.alias("request_json"))
    return analysis.analyze(rows, first_words, "spine_index", analysis.check_generated).select("spine_index", "status", "error")


def length_judge(packet):
    """Plug-in judge used by the query: scores by answer length."""
    n = len(packet["answer"])
    return {"score": n % 5, "verdict": "supports", "evidence": packet["answer"][:10], "hard_failure": n % 2 == 0}


@query(
    "judge",
    """SELECT conv_id || '-' || turn AS packet_id, CASE WHEN length(text) % 5 = 4 THEN 'invalid' ELSE 'completed' END AS status,
         CASE WHEN length(text) % 5 = 4 THEN 'score' END AS error FROM conversations WHERE role = 'assistant'""",
)
def judge(spark, folder):
    rows = base.table(spark, folder, "conversations").where("role = 'assistant'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("packet_id"),
        F.to_json(F.struct(F.col("text").alias("answer"))).alias("request_json"),
    )
    return analysis.analyze(rows, length_judge, "packet_id", analysis.check_judgment).select("packet_id", "status", "error")


def citing(request):
    """Plug-in analyzer used by the query: cites every block of a chapter, some of them badly."""
    refs = []
    for block in request["blocks"]:
        end = block["n"] + 5 if block["ord"] % 11 == 5 else block["n"]
        fp = block["fp"][::-1] if block["ord"] % 13 == 6 else block["fp"]
        name = "nowhere" if block["ord"] % 17 == 9 else block["block_id"]
        refs.append({"block_id": name, "start_char": 0, "end_char": end, "text_fingerprint": fp})
    text = request["title"] or "untitled"
    return {
        "summary": {"one_sentence": text, "short": text, "deep": text, "role_in_book": "part"},
        "concepts": [{"source_refs": refs}],
        "claims": [{"evidence": [] if request["spine_index"] % 7 == 3 else [{"source_ref": r} for r in refs[:2]]}],
        "usage": None if request["spine_index"] % 5 == 2 else {"input_tokens": 10, "output_tokens": 1},
    }


@query(
    "analyze_grounded",
    """SELECT spine_index, CASE WHEN codes <> '' THEN 'invalid' WHEN spine_index % 5 = 2 THEN 'unknown_usage' ELSE 'completed' END AS status,
         CASE WHEN codes <> '' THEN 'ungrounded' END AS error, codes FROM (
         SELECT spine_index, concat_ws(',', CASE WHEN spine_index % 7 = 3 THEN 'claim_without_evidence' END,
             CASE WHEN bool_or(ord % 13 = 6 AND ord % 17 <> 9) THEN 'fingerprint_mismatch' END, CASE WHEN bool_or(ord % 11 = 5 AND ord % 17 <> 9) THEN 'invalid_char_range' END,
             CASE WHEN bool_or(ord % 17 = 9) THEN 'missing_source_ref' END) AS codes
         FROM v_blocks GROUP BY spine_index)""",
)
def analyze_grounded(spark, folder):
    """Every chapter through an analyzer, its citations joined with the blocks behind the call."""
    blocks = base.blocks(spark, folder)
    entry = F.struct("ord", "block_id", F.col("n_chars").alias("n"), "fp")
    chapters = blocks.groupBy("book_id", "spine_index").agg(F.array_sort(F.collect_list(entry)).alias("blocks"))
    named = chapters.join(base.chapters(spark, folder).select("spine_index", "title"), "spine_index")
    rows = named.select("spine_index", F.to_json(F.struct("spine_index", "title", "blocks")).alias("request_json"))
    outputs = durable(analysis.analyze(rows, citing, "spine_index", analysis.check_generated, usage=lambda p: p["usage"]))
    made = analysis.grounded(outputs, chapters, blocks, "spine_index")
    return made.select("spine_index", "status", "error", F.array_join("codes", ",").alias("codes"))


# --- package life ---------------------------------------------------------------


@query(
    "compile_status",
    """SELECT r.book_id, CASE WHEN num % 6 = 1 THEN 'parse,normalize' WHEN num % 6 = 2 THEN 'parse,normalize,chapter_analysis' WHEN r.error_count > 0 AND num % 6 <> 3 THEN 'parse,normalize,chapter_analysis,book_synthesis'
           ELSE 'parse,normalize,chapter_analysis,book_synthesis,grounding_validation' END AS ready_stages,
         CASE WHEN num % 6 = 1 THEN analyzed_chapter_count - half ELSE analyzed_chapter_count END AS analyzed_chapters, analyzed_chapter_count AS total_chapters,
         num % 6 NOT IN (1, 2) AND (r.error_count = 0 OR num % 6 = 3) AS complete,
         CASE WHEN num % 6 NOT IN (1, 2, 3) AND r.error_count > 0 THEN 'grounding validation failed' END AS error
       FROM (SELECT *, CAST(substring(book_id, 4) AS BIGINT) AS num FROM v_report) r JOIN (SELECT book_id, count(*) FILTER (spine_index % 40 >= 20) AS half FROM v_analyses GROUP BY ALL) USING (book_id)""",
)
def compile_status(spark, folder):
    """By book number: some are half analysed, some not synthesised, some accepted despite errors."""
    number = F.substring("book_id", 4, 9).cast("long")
    analyses = package.chapter_analyses(spark, folder)
    chapters = corpus.chapter_items(base.chapters_raw(spark, folder)).withColumn("block_count", F.size("items"))
    done = analyses.where((number % 6 != 1) | (F.col("spine_index") % 40 < 20)).select("book_id")
    synthesized = analyses.where(number % 6 != 2).select("book_id")
    grounded = qg.report(spark, folder).select("book_id", (F.col("valid") | (number % 6 == 3)).alias("valid"))
    status = analysis.compile_status(chapters, done, synthesized, grounded)
    return status.withColumn("ready_stages", F.array_join("ready_stages", ","))


view(
    "v_versions",
    """SELECT user_id % 20 AS book_no, event_id AS seq, event_type <> 'error' AS complete, k % 4 AS violations, sha256('b' || user_id % 20) AS source_hash,
         CASE WHEN k % 9 = 0 THEN 'zz' ELSE left(sha256('b' || user_id % 20), 16) END || '-' || event_id AS version_id, session_id FROM v_events""",
)


def versions(spark, folder):
    from lectern.plans import reader

    number = F.col("user_id") % 20
    source = F.sha2(F.concat(F.lit("b"), number.cast("string")), 256)
    return reader.events(spark, folder).select(
        number.alias("book_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("complete"),
        (F.col("k") % 4).alias("violations"),
        source.alias("source_hash"),
        F.concat(F.when(F.col("k") % 9 == 0, "zz").otherwise(F.substring(source, 1, 16)), F.lit("-"), F.col("event_id").cast("string")).alias("version_id"),
        "session_id",
        "k",
    )


@query(
    "publishable",
    """SELECT book_no AS book_id, arg_max(version_id, seq) FILTER (ok) AS active_version, count(*) AS candidates, count(*) FILTER (NOT ok) AS held_back
       FROM (SELECT *, complete AND violations = 0 AND starts_with(version_id, left(source_hash, 16)) AS ok FROM v_versions) GROUP BY book_no""",
)
def publishable(spark, folder):
    return packages.publishable(versions(spark, folder))


@query(
    "reusable_packages",
    """SELECT book_no AS book_id, seq FROM v_versions WHERE complete AND violations = 0 AND (seq * 3) % 5 <> 0""",
)
def reusable_packages(spark, folder):
    """Each event asks for the package of the same number; some ask for another profile."""
    rows = versions(spark, folder)
    made = rows.select(
        "book_id", "source_hash", F.lit("standard").alias("profile"), F.lit(None).cast("long").alias("analyzed_through"),
        F.col("seq").cast("string").alias("analysis_key"), "complete", F.lit(True).alias("grounded"), "violations",
    )
    wanted = rows.select(
        "book_id", "seq", "source_hash", F.when((F.col("seq") * 3) % 5 == 0, "deep").otherwise("standard").alias("profile"),
        F.lit(None).cast("long").alias("analyzed_through"), F.col("seq").cast("string").alias("analysis_key"),
    )
    return analysis.reusable_packages(made, wanted).select("book_id", "seq")


@query(
    "stage_progress",
    """SELECT session_id AS book_id, seq, k % 13 = 0 AND k % 5 > 0 AS not_prefix, coalesce(k % 5 < lag(k % 5) OVER (PARTITION BY session_id ORDER BY seq), false) AS shrinks
       FROM (SELECT session_id, event_id AS seq, k FROM v_events) QUALIFY not_prefix OR shrinks""",
)
def stage_progress(spark, folder):
    stages = F.array(*[F.lit(s) for s in analysis.STAGES])
    size = (F.col("k") % 5).cast("int")
    odd = F.array(*[F.lit("indexing")] * 5)
    rows = versions(spark, folder).select(
        F.col("session_id").alias("book_id"), "seq", F.slice(F.when(F.col("k") % 13 == 0, odd).otherwise(stages), F.lit(1), size).alias("ready_stages")
    )
    return analysis.stage_progress(rows)


@query("attempt_numbers", "SELECT session_id AS book_id, event_id AS seq, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS attempt FROM v_events")
def attempt_numbers(spark, folder):
    return analysis.attempt_numbers(versions(spark, folder).select(F.col("session_id").alias("book_id"), "seq"))


@query(
    "stale_packages",
    """SELECT 'src' || (spine_index % 20) AS book_id, href AS document, CASE WHEN spine_index % 7 = 2 THEN 'stale_source' ELSE 'other_version' END AS code
       FROM v_chapters WHERE spine_index % 7 = 2 OR spine_index % 11 = 3""",
)
def stale_packages(spark, folder):
    s = F.col("spine_index")
    rows = base.chapters(spark, folder)
    documents = rows.select(
        "book_id",
        F.col("href").alias("document"),
        F.when(s % 7 == 2, "old").otherwise(F.sha2("book_id", 256)).alias("source_hash"),
        F.when(s % 11 == 3, "0").otherwise("1").alias("schema_version"),
    )
    manifests = rows.select("book_id", F.sha2("book_id", 256).alias("source_hash")).distinct()
    return packages.stale_packages(documents, manifests, "1")


@query(
    "package_listing",
    """SELECT book_id, name, CASE WHEN name = 'blocks.jsonl' THEN 'application/x-ndjson' ELSE 'application/json' END AS media_type, '/v1/books/' || book_id || '/files/' || name AS href FROM (
         SELECT book_id, unnest(CASE WHEN CAST(substring(book_id, 4) AS BIGINT) % 3 = 0 THEN ['manifest.json', 'blocks.jsonl'] ELSE ['manifest.json', 'blocks.jsonl', 'concepts.json'] END) AS name
         FROM (SELECT DISTINCT book_id FROM v_chapters))""",
)
def package_listing(spark, folder):
    number = F.substring("book_id", 4, 9).cast("long")
    names = [F.lit(n) for n in ("manifest.json", "blocks.jsonl", "notes.txt")]
    present = base.chapters(spark, folder).select("book_id").distinct().select(
        "book_id",
        F.explode(F.when(number % 3 == 0, F.array(*names)).otherwise(F.array(*names, F.lit("concepts.json")))).alias("document"),
        F.sha2("book_id", 256).alias("source_hash"),
    )
    return packages.package_listing(present).drop("source_hash")


@query(
    "locate_blocks",
    """SELECT c.path, b.spine_index, b.ord, CASE WHEN b.block_id IS NULL THEN 'unknown_block' END AS error FROM v_cites c LEFT JOIN v_blocks b USING (block_id)""",
)
def locate_blocks(spark, folder):
    """Every cited block id looked up."""
    asked = package.citation_rows(package.chapter_analyses(spark, folder)).select("book_id", "path", "block_id")
    return packages.locate_blocks(asked, base.blocks(spark, folder)).select("path", "spine_index", "ord", "error")


@query(
    "book_dashboard",
    """SELECT a.book_id, a.spine_index, a.block_count, true AS has_analysis, n.concepts, n.claims FROM v_analyses a JOIN (
         SELECT c.book_id, count(*) AS concepts, (SELECT count(*) FROM v_claims k WHERE k.book_id = c.book_id) AS claims FROM v_concepts c GROUP BY c.book_id) n USING (book_id)
       UNION ALL SELECT c.book_id, c.spine_index, 0, false, (SELECT count(*) FROM v_concepts k WHERE k.book_id = c.book_id), (SELECT count(*) FROM v_claims k WHERE k.book_id = c.book_id)
       FROM v_chapters c WHERE NOT is_noise AND spine_index NOT IN (SELECT spine_index FROM v_analyses)""",
)
def book_dashboard(spark, folder):
    analyses = package.stored_analyses(spark, folder)
    chapters = corpus.chapter_items(base.chapters_raw(spark, folder)).withColumn("block_count", F.size("items").cast("long"))
    return review_dashboard(chapters, analyses)


def review_dashboard(chapters, analyses):
    from lectern.operators.review import book_dashboard as build

    return build(chapters, analyses, package.concepts(analyses), package.claims(analyses))


view(
    "v_published",
    """SELECT book_no, arg_max(version_id, seq) AS version_id, max(seq) AS seq FROM (
         SELECT book_no, event_id % 3 AS round, max(seq) AS seq, arg_max(version_id, seq) AS version_id,
           arg_max(complete AND violations = 0 AND starts_with(version_id, left(source_hash, 16)), seq) AS ok
         FROM (SELECT *, seq AS event_id FROM v_versions) GROUP BY ALL) WHERE ok GROUP BY book_no""",
)


@query(
    "published_packages",
    """SELECT c.book_id, p.version_id, c.spine_index AS pos, sha256(CAST(to_json({'title': c.title, 'version': p.version_id}) AS VARCHAR)) AS json_hash
       FROM v_published p JOIN v_chapters c ON c.book_id = 'src' || p.book_no""",
)
def published_packages(spark, folder):
    """Three rounds of candidates, one per book and round, written, audited and published; what readers see then."""
    import uuid

    from lectern.session import checkpoint_dir
    from lectern.sinks import publish

    root = f"{checkpoint_dir(spark)}/lectern-packages-{uuid.uuid4().hex}"
    fields = ["version_id", "seq", "complete", "violations", "source_hash"]
    chapters = base.chapters(spark, folder)
    rows = versions(spark, folder)
    for number in range(3):
        newest = rows.where(F.col("seq") % 3 == number).groupBy("book_id").agg(F.max_by(F.struct(*fields), "seq").alias("v"))
        candidates = newest.select(F.concat(F.lit("src"), F.col("book_id").cast("string")).alias("book_id"), "v.*")
        documents = chapters.join(candidates.select("book_id", "version_id"), "book_id").select(
            "book_id", "version_id", F.lit("structure.json").alias("document"), F.col("spine_index").alias("pos"),
            F.to_json(F.struct("title", F.col("version_id").alias("version"))).alias("json"),
        )
        publish.run(spark, root, documents, candidates)
    seen = publish.read_active(spark, root)
    return seen.select("book_id", "version_id", "pos", F.sha2("json", 256).alias("json_hash"))
