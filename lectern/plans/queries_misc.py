"""Remaining lookups, rule tables and small composed operators."""

from pyspark.sql import functions as F

from lectern.functions import numbers
from lectern.functions import text as T
from lectern.operators import actions, analysis, grounding, packages, reading, scoring
from lectern.plans import base, package, reader
from lectern.plans import queries_actions as qa
from lectern.plans import queries_io as qio
from lectern.plans import queries_review as qv
from lectern.plans import queries_sections as qsec
from lectern.plans import queries_grounding as qg
from lectern.plans.registry import SQL, query, view
from lectern.session import durable


@query(
    "reading_layout",
    "SELECT book_id, CAST(substring(book_id, 4) AS BIGINT) % 2 = 0 AS overlaid, count(*) AS chapters FROM v_chapters GROUP BY ALL",
)
def reading_layout(spark, folder):
    """Chapters as sections in every second book; readers of the others stay physical."""
    rows = base.chapters(spark, folder)
    sections = rows.where(F.substring("book_id", 4, 9).cast("long") % 2 == 0).select(
        "book_id",
        F.col("spine_index").alias("section_index"),
        T.chapter_id(F.col("spine_index")).alias("chapter_id"),
        "title",
        F.col("spine_index").alias("start_position"),
        (F.col("spine_index") + 1).alias("end_position"),
    )
    layouts = packages.reading_layout(sections, rows.select("book_id").distinct())
    return (
        rows.join(layouts, "book_id")
        .groupBy("book_id", F.col("layout").startswith("sections-v1-").alias("overlaid"))
        .agg(F.count(F.lit(1)).alias("chapters"))
    )


@query(
    "states_of_other_layout",
    "SELECT user_id, event_id FROM v_events WHERE user_id % 2 = 1 AND k % 3 = 0 OR user_id % 2 = 0 AND k % 3 <> 0",
)
def states_of_other_layout(spark, folder):
    """Saved states name a layout; books with an odd number have the physical one."""
    ev = reader.events(spark, folder)
    layout = lambda cond: F.when(cond, "physical-v1").otherwise("sections-v1-x")
    states = ev.select("user_id", "event_id", (F.col("user_id") % 20).alias("book_id"), layout(F.col("k") % 3 != 0).alias("layout"))
    now = states.select("book_id").distinct().select("book_id", layout(F.col("book_id") % 2 == 1).alias("layout"))
    return packages.states_of_other_layout(states, now).select("user_id", "event_id")


@query(
    "failure_codes",
    """SELECT event_id, CASE k % 5 WHEN 0 THEN 503 WHEN 1 THEN 504 WHEN 2 THEN 409 WHEN 3 THEN 413 ELSE 502 END::BIGINT AS status,
         CASE k % 5 WHEN 0 THEN 'busy' WHEN 1 THEN 'timeout' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'context_too_large' ELSE 'invalid_agent_response' END AS code FROM v_events""",
)
def failure_codes(spark, folder):
    names = F.array(*[F.lit(x) for x in ("busy", "timeout", "cancelled", "context_too_large", "crashed")])
    outcomes = reader.events(spark, folder).select("event_id", F.element_at(names, (F.col("k") % 5 + 1).cast("int")).alias("outcome"))
    return packages.failure_codes(outcomes).drop("outcome")


@query(
    "ledger_config_rules",
    """SELECT event_id, 'evidence' AS code FROM v_events WHERE event_type NOT IN ('view', 'click') UNION ALL SELECT event_id, 'max_invocations' FROM v_events WHERE k = 0
       UNION ALL SELECT event_id, 'request_budget' FROM v_events WHERE k * 6000 > 524288 UNION ALL SELECT event_id, 'max_request_bytes' FROM v_events WHERE k = 0
       UNION ALL SELECT event_id, 'config_fields' FROM v_events WHERE event_type = 'signup' UNION ALL SELECT event_id, 'cached_rate' FROM v_events WHERE k % 7 > 5
       UNION ALL SELECT event_id, 'pricing_date' FROM v_events WHERE k % 11 = 3""",
)
def ledger_config_rules(spark, folder):
    """A configuration per event, some with bad fields."""
    k = F.col("k")
    pricing = F.struct(
        F.lit("list").alias("source"),
        F.when(k % 11 == 3, "soon").otherwise("2026-01-01").alias("as_of"),
        F.lit(5).alias("input_per_million"),
        (k % 7).alias("cached_input_per_million"),
        F.lit(50).alias("output_per_million"),
    )
    config = F.struct(
        F.when(F.col("event_type").isin("view", "click"), "online").otherwise("replay").alias("evidence"),
        F.lit("run.py").alias("adapter"),
        F.lit("model-1").alias("model"),
        k.alias("max_invocations"),
        (k * 6000).alias("max_request_bytes"),
        F.lit(10).alias("stop_after_input_tokens"),
        F.lit(10).alias("stop_after_output_tokens"),
        F.lit(1.5).alias("stop_after_estimated_usd"),
        pricing.alias("pricing"),
        F.when(F.col("event_type") == "signup", "x").alias("secret"),
    )
    rows = reader.events(spark, folder).select("event_id", F.to_json(config).alias("json"))
    return packages.ledger_config_issues(rows, "event_id", "json")


@query(
    "chapter_content",
    """SELECT doc_id AS request_id, doc_id * 2 AS spine_index, ord, block_id, CASE WHEN c.spine_index IS NULL THEN 'unknown_chapter' END AS error
       FROM documents LEFT JOIN v_chapters c ON c.spine_index = doc_id * 2 LEFT JOIN v_blocks b ON b.spine_index = doc_id * 2""",
)
def chapter_content(spark, folder):
    """Each document asks for the chapter with twice its number."""
    asked = base.table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"), F.format_string("src%d", F.col("doc_id") * 2 % 20).alias("book_id"), (F.col("doc_id") * 2).alias("spine_index")
    )
    return packages.chapter_content(asked, base.chapters(spark, folder), base.blocks(spark, folder)).drop("book_id")


@query(
    "reanalysis_requests",
    """SELECT book_id, spine_index, chapter_id, row_number() OVER (PARTITION BY book_id ORDER BY spine_index) - 1 AS n_earlier, sha256(short) AS short_hash FROM v_shorts""",
)
def reanalysis_requests(spark, folder):
    analyses = package.stored_analyses(spark, folder)
    made = analysis.reanalysis_requests(analyses.select("book_id", "spine_index", "chapter_id"), analyses)
    return made.select("book_id", "spine_index", "chapter_id", "n_earlier", F.sha2("summary.short", 256).alias("short_hash"))


view(
    "v_shorts",
    """SELECT book_id, spine_index, chapter_id, CASE WHEN spine_index % 10 = 3 THEN '  ' ELSE substring(first_text, 1, 160) END AS short FROM v_analyses""",
)


@query(
    "earlier_summaries",
    "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY spine_index) - 1 AS place, spine_index, sha256(short) AS short_hash FROM v_shorts",
)
def earlier_summaries(spark, folder):
    """The list that every request of a book refers to by place."""
    made = analysis.earlier_summaries(package.stored_analyses(spark, folder))
    return made.select("book_id", "place", "spine_index", F.sha2("short", 256).alias("short_hash"))


@query(
    "ordered_results",
    """SELECT a.book_id, a.spine_index, coalesce(r.artifacts, '') AS artifacts FROM v_analyses a LEFT JOIN (
         SELECT spine_index, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS artifacts FROM v_events GROUP BY ALL) r USING (spine_index)""",
)
def ordered_results(spark, folder):
    analyses = package.chapter_analyses(spark, folder).select("book_id", "spine_index")
    made = reader.events(spark, folder).select(
        F.format_string("src%d", F.col("spine_index") % 20).alias("book_id"), "spine_index", F.col("event_type").alias("artifact")
    )
    return analysis.ordered_results(analyses, made).select(
        "book_id", "spine_index", F.coalesce(F.array_join("artifacts", ","), F.lit("")).alias("artifacts")
    )


@query(
    "reflect_requests",
    """SELECT r.request_id, CASE WHEN c.session_id IS NULL AND s.session_id IS NOT NULL AND a.spine_index IS NOT NULL THEN 'forbidden' WHEN a.spine_index IS NULL THEN 'unknown_checkpoint'
         WHEN s.session_id IS NULL THEN 'forbidden' WHEN NOT coalesce(v.completed, false) THEN 'beyond_coverage' WHEN r.n % 4 = 0 THEN 'unknown_question' END AS error
       FROM (SELECT conv_id || '-' || turn AS request_id, 'u' || conv_id AS session_id, length(text) AS n FROM conversations WHERE role = 'assistant') r
       LEFT JOIN v_sessions s USING (session_id) LEFT JOIN v_analyses a ON a.spine_index = s.spine_index
       LEFT JOIN v_coverage c ON c.session_id = r.session_id AND c.spine_index = s.spine_index
       LEFT JOIN v_covered v ON v.session_id = r.session_id AND v.spine_index = s.spine_index""",
)
def reflect_requests(spark, folder):
    """Assistant turns answer the checkpoint of the chapter their reader is in."""
    blocks, cover = base.blocks(spark, folder), reader.coverage(spark, folder)
    points = package.checkpoints(package.chapter_analyses(spark, folder))
    sessions = durable(reader.sessions(spark, folder))
    opened = actions.checkpoint_requests(
        sessions.select(F.col("session_id").alias("request_id"), "session_id", "book_id", "spine_index"), cover, reading.covered_chapters(blocks, cover), points
    )
    n = F.char_length("text")
    place = sessions.select("session_id", "book_id", F.col("spine_index").cast("string").alias("_s"))
    s = F.col("spine")
    turns = base.table(spark, folder, "conversations").where("role = 'assistant'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("text").alias("answer"),
        n.alias("n"),
    )
    number = F.col("_s").cast("long")
    own = F.when(number % 50 == 10, number - 20).otherwise(number).cast("string")
    asked = turns.join(place, "session_id", "left").select(
        "request_id",
        "session_id",
        "book_id",
        F.coalesce(F.concat(F.lit("checkpoint-"), "_s"), F.lit("none")).alias("checkpoint_id"),
        F.when(F.col("n") % 4 == 0, "other").otherwise(F.concat(F.lit("recall-"), own)).alias("question_id"),
        "answer",
    )
    return actions.reflect_requests(asked, opened, points).select("request_id", "error")


@query(
    "artifact_hash",
    """SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || k || ',"mode":' || coalesce('"' || mode || '"', 'null') || '}') AS hash FROM v_events""",
)
def artifact_hash(spark, folder):
    return reader.events(spark, folder).select(
        "event_id", T.artifact_hash(F.col("event_type"), F.col("k"), F.col("mode")).alias("hash")
    )


@query(
    "confidence_default",
    """SELECT spine_index, CASE WHEN n_refs > 0 THEN 9000 ELSE 6000 END::BIGINT AS summary, CASE WHEN spine_index % 3 = 0 THEN 9000 ELSE 6500 END::BIGINT AS explanation,
         n_refs * 10000 // nullif(spine_index % 5, 0) AS raw, CASE WHEN spine_index % 5 > 0 THEN least(10000, n_refs * 10000 // (spine_index % 5)) ELSE 0 END::BIGINT AS share FROM v_concepts""",
)
def confidence_default(spark, folder):
    concepts = package.concepts(package.chapter_analyses(spark, folder))
    n, d = F.size("appearances"), F.col("spine_index") % 5
    return concepts.select(
        "spine_index",
        numbers.confidence_default(n > 0).alias("summary"),
        numbers.confidence_default(n > 0, difficult=F.col("spine_index") % 3 == 0, explanation=True).alias("explanation"),
        F.expr("size(appearances) * 10000L div nullif(spine_index % 5, 0)").alias("raw"),
        numbers.basis_points(n, d, empty=0).alias("share"),
    )


@query(
    "metric_baseline",
    """SELECT book_id, metric, 'metric_regression' AS code FROM v_metrics WHERE value IS NOT NULL AND CAST(substring(book_id, 4) AS BIGINT) % 5 = 2""",
)
def metric_baseline(spark, folder):
    """Frozen minimums lie above the present values of every fifth book."""
    now = durable(qv.reported_metrics(spark, folder)[0].select("book_id", "metric", "state", "value"))
    raised = F.when(F.substring("book_id", 4, 9).cast("long") % 5 == 2, 1).otherwise(0)
    return scoring.metric_baseline(now, now.withColumn("value", F.col("value") + raised))


@query(
    "comparable_runs",
    """SELECT 'roles' AS pair_id, x AS incomparable FROM (SELECT unnest(['attempts', 'compiler']) AS x), (SELECT count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations)
       WHERE (x = 'attempts' AND u <> a) OR x = 'compiler'""",
)
def comparable_runs(spark, folder):
    """Manifests counted from user and from assistant turns, with different compilers."""
    conv = base.table(spark, folder, "conversations")

    def manifest(role, compiler):
        return conv.where(F.col("role") == role).agg(F.count(F.lit(1)).alias("attempts")).select(
            F.lit("roles").alias("pair_id"), "attempts", F.lit("0.0").alias("protocol"), F.lit(compiler).alias("compiler"), F.lit("A0").alias("candidate")
        )

    return scoring.comparable_runs(
        manifest("user", "offline-registration"), manifest("assistant", "configured-provider"), ["protocol", "attempts"]
    )


# Rule families of a package check and how each names its findings.
_FAMILIES = {
    "count_consistency": "'count_mismatch_' || measure",
    "block_rules": "code",
    "jsonl_equals_book": "CASE WHEN only_left + only_right > 0 THEN 'blocks_differ_from_book' END",
    "stale_packages": "code",
    "recall_matches": "CASE WHEN only_left + only_right > 0 THEN 'recall_cards_differ' END",
    "exact_cover": "'cover_' || code || '_' || subject",
    "path_rules": "CASE WHEN NOT valid THEN 'reading_paths' END",
    "partition_check": "code",
}


@query(
    "validate_packages",
    """SELECT book_id, code, count(*) AS n FROM (SELECT book_id, code FROM v_synthesis_issues UNION ALL SELECT book_id, code FROM v_issues
         UNION ALL SELECT book_id, 'duplicate_id' FROM (SELECT book_id FROM v_question_ids GROUP BY book_id, kind, id HAVING count(*) > 1)
         UNION ALL SELECT book_id, 'dangling_id' FROM v_references r WHERE NOT EXISTS (SELECT 1 FROM v_question_ids q WHERE q.book_id = r.book_id AND q.kind = r.kind AND q.id = r.id)
         """
    + "".join(f"UNION ALL SELECT book_id, {code} FROM ({SQL[name]}) " for name, code in _FAMILIES.items())
    + ") WHERE code IS NOT NULL GROUP BY ALL",
)
def validate_packages(spark, folder):
    """All rule families together: codes and their numbers per book."""
    blocks = base.stored_blocks(spark, folder)
    analyses, checked, _ = qg.resolved(spark, folder, blocks)
    unsupported = grounding.claims_without_evidence(analyses, package.claims(analyses))
    declared = qg.declared_ids(analyses)
    found = {
        "count_consistency": qg.count_consistency,
        "block_rules": qg.block_rules,
        "jsonl_equals_book": qio.jsonl_equals_book,
        "stale_packages": qv.stale_packages,
        "recall_matches": qg.recall_matches,
        "exact_cover": qg.exact_cover,
        "path_rules": qg.path_rules,
        "partition_check": qsec.partition_check,
    }
    # Families about the same tables read the same stored ones.
    given = {name: {"blocks": blocks} for name in ("count_consistency", "block_rules", "jsonl_equals_book", "partition_check")}
    given |= {name: {"analyses": analyses} for name in ("recall_matches", "exact_cover", "path_rules")}
    families = [
        fn(spark, folder, **given.get(name, {})).select("book_id", F.expr(_FAMILIES[name]).alias("code")).where("code is not null")
        for name, fn in found.items()
    ]
    return packages.package_violations(
        [
            qg.synthesis(analyses),
            grounding.grounding_issues(checked, unsupported),
            grounding.duplicate_ids(declared),
            grounding.dangling_ids(qg.references(analyses), declared).withColumn("code", F.lit("dangling_id")),
            *families,
        ]
    )
