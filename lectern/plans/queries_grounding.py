"""Grounding and package-rule queries over the derived package."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import grounding
from lectern.plans import base, package
from lectern.plans.registry import query, view
from lectern.session import durable


@query(
    "all_citations",
    "SELECT book_id, path, block_id, CAST(start_char AS BIGINT) AS start_char, end_char, text_fingerprint, CAST(max_chapter AS BIGINT) AS max_chapter FROM v_cites",
)
def all_citations(spark, folder):
    return package.citation_rows(package.chapter_analyses(spark, folder))


view(
    "v_resolved",
    """SELECT c.*, b.block_id IS NOT NULL AS resolved,
         b.block_id IS NULL AS missing_source_ref,
         b.block_id IS NOT NULL AND (c.start_char >= c.end_char OR c.end_char > b.n_chars) AS invalid_char_range,
         b.block_id IS NOT NULL AND c.text_fingerprint <> b.fp AS fingerprint_mismatch,
         b.block_id IS NOT NULL AND coalesce(b.spine_index > c.max_chapter, false) AS spoiler_boundary
       FROM v_cites c LEFT JOIN v_blocks b ON b.book_id = c.book_id AND b.block_id = c.block_id""",
)
view(
    "v_unsupported",
    """SELECT book_id, 'chapters/' || chapter_id || '.analysis.json.claims[' || idx || ']' AS path FROM v_ref_rows WHERE kind = 1 AND h % 5 = 0
       UNION ALL SELECT book_id, 'claims.json.claims[' || claim_id || ']' FROM v_claims WHERE NOT has_evidence""",
)
view(
    "v_issues",
    """SELECT book_id, path, 'missing_source_ref' AS code FROM v_resolved WHERE missing_source_ref
       UNION ALL SELECT book_id, path, 'invalid_char_range' FROM v_resolved WHERE invalid_char_range
       UNION ALL SELECT book_id, path, 'fingerprint_mismatch' FROM v_resolved WHERE fingerprint_mismatch
       UNION ALL SELECT book_id, path, 'spoiler_boundary' FROM v_resolved WHERE spoiler_boundary
       UNION ALL SELECT book_id, path, 'claim_without_evidence' FROM v_unsupported""",
)


class Resolved(NamedTuple):
    """Stored analyses, their citations held against the blocks, and the stored ids of the blocks."""

    analyses: DataFrame
    checked: DataFrame
    blocks: DataFrame


def resolved(spark, folder, blocks=None):
    analyses = package.stored_analyses(spark, folder)
    if blocks is None:
        blocks = durable(base.blocks(spark, folder).select("book_id", "spine_index", "block_id", "n_chars", "fp"))
    return Resolved(analyses, grounding.resolve_refs(package.citation_rows(analyses), blocks), blocks)


@query("resolve_refs", "SELECT book_id, path, code FROM v_issues")
def resolve_refs(spark, folder):
    analyses, checked, _ = resolved(spark, folder)
    return grounding.grounding_issues(
        checked, grounding.claims_without_evidence(analyses, package.claims(analyses))
    )


view(
    "v_report",
    """SELECT a.book_id, a.analyzed_chapter_count, r.source_ref_count, r.cited_block_count, a.analyzed_block_count,
         least(10000, r.cited_block_count * 10000 // a.analyzed_block_count) AS summary_coverage_basis_points,
         coalesce(i.error_count, 0) AS error_count
       FROM (SELECT book_id, count(*) AS analyzed_chapter_count, CAST(sum(block_count) AS BIGINT) AS analyzed_block_count
             FROM v_analyses GROUP BY ALL) a
       JOIN (SELECT book_id, count(*) AS source_ref_count, count(DISTINCT block_id) FILTER (resolved) AS cited_block_count
             FROM v_resolved GROUP BY ALL) r USING (book_id)
       LEFT JOIN (SELECT book_id, count(*) AS error_count FROM v_issues GROUP BY ALL) i USING (book_id)""",
)


def report(spark, folder, found=None):
    """One row per book; a query that needs more than the report gives what it has resolved."""
    analyses, checked, blocks = found or resolved(spark, folder)
    unsupported = grounding.claims_without_evidence(analyses, package.claims(analyses))
    counted = durable(checked.select("book_id", "block_id", "codes", "resolved"))
    return grounding.grounding_report(counted, unsupported, analyses, blocks)


@query(
    "grounding_report",
    """SELECT *, summary_coverage_basis_points < 5000 AS low_summary_coverage, error_count = 0 AS valid FROM v_report""",
)
def grounding_report(spark, folder):
    return report(spark, folder)


view(
    "v_question_ids",
    """SELECT book_id, 'question' AS kind, 'recall-' || CASE WHEN spine_index % 50 = 10 THEN spine_index - 20 ELSE spine_index END AS id FROM v_analyses
       UNION ALL SELECT book_id, 'question', 'reflect-' || spine_index FROM v_analyses WHERE spine_index % 23 <> 0
       UNION ALL SELECT book_id, 'flashcard', 'card-' || spine_index FROM v_analyses
       UNION ALL SELECT book_id, 'checkpoint', 'checkpoint-' || spine_index FROM v_analyses
       UNION ALL SELECT book_id, 'concept', concept_id FROM v_concepts
       UNION ALL SELECT book_id, 'claim', claim_id FROM v_claims
       UNION ALL SELECT book_id, 'entity', entity_id FROM v_entities""",
)


def declared_ids(analyses):
    """Ids of every kind; question ids are unique over recall and reflection together."""
    points = package.checkpoints(analyses)
    questions = points.select("book_id", F.explode(F.concat("recall_questions", "reflection_questions")).alias("q"))
    cards = points.select("book_id", F.explode("flashcards").alias("c"))

    def ids(df, kind, col):
        return df.select("book_id", F.lit(kind).alias("kind"), F.col(col).alias("id"))

    return base.union_all(
        [
            ids(questions, "question", "q.question_id"),
            ids(cards, "flashcard", "c.flashcard_id"),
            ids(points, "checkpoint", "checkpoint_id"),
            ids(package.concepts(analyses), "concept", "concept_id"),
            ids(package.claims(analyses), "claim", "claim_id"),
            ids(package.entities(analyses), "entity", "entity_id"),
        ]
    )


@query(
    "duplicate_ids",
    """SELECT book_id, kind, id, count(*) AS n, 'duplicate_id' AS code FROM v_question_ids GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_ids(spark, folder):
    return grounding.duplicate_ids(declared_ids(package.stored_analyses(spark, folder)))


view(
    "v_references",
    """SELECT book_id, 'concept' AS kind, concept_id AS owner, 'concept-' || (spine_index + 20) AS id FROM v_concepts
       UNION ALL SELECT book_id, 'claim', claim_id, depends_on FROM v_claims
       UNION ALL SELECT book_id, 'entity', entity_id, 'entity-' || (spine_index + 40) FROM v_entities
       UNION ALL SELECT book_id, 'concept', 'card-' || spine_index, 'concept-' || spine_index FROM v_analyses
       UNION ALL SELECT book_id, 'concept', 'card-' || spine_index, 'concept-' || (spine_index + 60) FROM v_analyses""",
)


def references(analyses):
    def refs(df, kind, owner, ids):
        return df.select(
            "book_id", F.lit(kind).alias("kind"), F.col(owner).alias("owner"), F.explode(ids).alias("id")
        )

    cards = package.checkpoints(analyses).select("book_id", F.explode("flashcards").alias("c"))
    return base.union_all(
        [
            refs(package.concepts(analyses), "concept", "concept_id", "related_ids"),
            refs(package.claims(analyses), "claim", "claim_id", "depends_on"),
            refs(package.entities(analyses), "entity", "entity_id", "related_ids"),
            refs(cards, "concept", "c.flashcard_id", "c.concept_ids"),
        ]
    )


@query(
    "dangling_ids",
    """SELECT book_id, kind, owner, id FROM v_references r WHERE NOT EXISTS (
         SELECT 1 FROM v_question_ids q WHERE q.book_id = r.book_id AND q.kind = r.kind AND q.id = r.id)""",
)
def dangling_ids(spark, folder):
    analyses = package.stored_analyses(spark, folder)
    return grounding.dangling_ids(references(analyses), declared_ids(analyses)).select("book_id", "kind", "owner", "id")


view(
    "v_cover",
    """SELECT 'role' AS subject, book_id, spine_index FROM (SELECT *, unnest(CASE WHEN spine_index % 40 = 39 THEN []
           WHEN spine_index % 60 = 5 THEN [1, 2] ELSE [1] END) FROM v_analyses)
       UNION ALL SELECT 'difficulty', book_id, spine_index FROM v_analyses WHERE spine_index % 33 <> 0
       UNION ALL SELECT 'checkpoint', book_id, spine_index FROM v_analyses""",
)


@query(
    "exact_cover",
    """SELECT s.subject, a.book_id, a.spine_index, coalesce(n, 0) AS n,
         CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS code
       FROM v_analyses a CROSS JOIN (SELECT DISTINCT subject FROM v_cover) s
       LEFT JOIN (SELECT subject, book_id, spine_index, count(*) AS n FROM v_cover GROUP BY ALL) c
         ON c.subject = s.subject AND c.book_id = a.book_id AND c.spine_index = a.spine_index
       WHERE coalesce(n, 0) <> 1""",
)
def exact_cover(spark, folder, analyses=None):
    analyses = package.stored_analyses(spark, folder) if analyses is None else analyses

    def as_cover(df, subject):
        return df.select(F.lit(subject).alias("subject"), "book_id", "spine_index")

    covering = base.union_all(
        [
            as_cover(package.chapter_roles(analyses), "role"),
            as_cover(package.difficulty(analyses), "difficulty"),
            as_cover(package.checkpoints(analyses), "checkpoint"),
        ]
    )
    return grounding.exact_cover(analyses, covering)


@query(
    "path_rules",
    """SELECT book_id, CASE WHEN CAST(substring(book_id, 4) AS BIGINT) % 7 = 3 THEN CAST(2 AS BIGINT) ELSE 3 END AS n_paths,
         CAST(substring(book_id, 4) AS BIGINT) % 7 <> 3 AS valid FROM (SELECT DISTINCT book_id FROM v_analyses)""",
)
def path_rules(spark, folder, analyses=None):
    analyses = package.chapter_analyses(spark, folder) if analyses is None else analyses
    return grounding.path_rules(analyses.select("book_id").distinct(), package.reading_paths(analyses))


view(
    "v_synthesis_issues",
    """SELECT book_id, 'concept' AS kind, concept_id AS id, 'score_out_of_range' AS code FROM v_concepts WHERE importance > 100
       UNION ALL SELECT book_id, 'concept', concept_id, 'grounded_without_refs' FROM v_concepts WHERE grounding = 'grounded' AND n_refs = 0
       UNION ALL SELECT book_id, 'claim', claim_id, 'score_out_of_range' FROM v_claims WHERE importance > 100
       UNION ALL SELECT book_id, 'claim', claim_id, 'claim_not_grounded' FROM v_claims WHERE NOT has_evidence OR grounding <> 'grounded'
       UNION ALL SELECT book_id, 'entity', entity_id, 'grounded_without_refs' FROM v_entities WHERE n_refs = 0
       UNION ALL SELECT book_id, 'checkpoint', 'checkpoint-' || spine_index, 'must_understand_count' FROM v_analyses WHERE least(spine_index % 7, 6) NOT BETWEEN 3 AND 5
       UNION ALL SELECT book_id, 'checkpoint', 'checkpoint-' || spine_index, 'missing_practice' FROM v_analyses WHERE spine_index % 23 = 0
       UNION ALL SELECT a.book_id, 'checkpoint', 'checkpoint-' || a.spine_index, 'blank_flashcard' FROM v_analyses a JOIN v_chapters c USING (spine_index) WHERE c.title = ''
       UNION ALL SELECT book_id, 'checkpoint', 'checkpoint-' || spine_index, 'grounded_without_refs' FROM v_concepts WHERE n_refs = 0 AND spine_index % 4 <> 0""",
)


def synthesis(analyses):
    return grounding.synthesis_issues(
        package.concepts(analyses), package.claims(analyses), package.entities(analyses), package.checkpoints(analyses)
    )


@query("synthesis_rules", "SELECT book_id, kind, id, code FROM v_synthesis_issues")
def synthesis_rules(spark, folder):
    return synthesis(package.stored_analyses(spark, folder))


view(
    "v_deck",
    """SELECT book_id, spine_index, 0 AS pos, 'question' AS kind,
         'recall-' || CASE WHEN spine_index % 50 = 10 THEN spine_index - 20 ELSE spine_index END AS id FROM v_analyses
       UNION ALL SELECT book_id, spine_index, 1, 'flashcard', 'card-' || spine_index FROM v_analyses""",
)


@query("recall_deck", "SELECT book_id, spine_index, CAST(pos AS BIGINT) AS pos, kind, id FROM v_deck")
def recall_deck(spark, folder):
    return grounding.recall_deck(package.checkpoints(package.chapter_analyses(spark, folder)))


@query(
    "recall_matches",
    """SELECT book_id, CAST(count(*) FILTER (spine_index % 13 = 0 AND pos = 1) AS BIGINT) AS only_left,
         CAST(count(*) FILTER (spine_index % 13 = 0 AND pos = 1) AS BIGINT) AS only_right FROM v_deck GROUP BY book_id""",
)
def recall_matches(spark, folder, analyses=None):
    """Stored deck against the recomputed one; some stored cards were renamed."""
    analyses = package.chapter_analyses(spark, folder) if analyses is None else analyses
    deck = grounding.recall_deck(package.checkpoints(analyses))
    renamed = (F.col("spine_index") % 13 == 0) & (F.col("pos") == 1)
    stored = deck.withColumn("id", F.when(renamed, F.concat("id", F.lit("-old"))).otherwise(F.col("id")))
    return grounding.same_rows(stored, deck, ["book_id"])


@query(
    "chapter_refs",
    """SELECT spine_index, coalesce(refs, '') AS refs, coalesce(n_refs, 0) AS n_refs FROM v_analyses LEFT JOIN (
       SELECT spine_index, string_agg(block_id || ':' || end_char || ':' || left(text_fingerprint, 8), ' ' ORDER BY block_id, seq) AS refs,
         count(*) AS n_refs
       FROM (SELECT *, lag(block_id || start_char || '-' || end_char || text_fingerprint) OVER (PARTITION BY spine_index ORDER BY block_id, seq) AS before
             FROM v_chapter_cites)
       WHERE before IS DISTINCT FROM block_id || start_char || '-' || end_char || text_fingerprint GROUP BY spine_index) USING (spine_index)""",
)
def chapter_refs(spark, folder):
    refs = grounding.chapter_refs(package.chapter_analyses(spark, folder))
    one = F.transform(
        "source_refs",
        lambda r: F.concat_ws(":", r["block_id"], r["end_char"].cast("string"), F.substring(r["text_fingerprint"], 1, 8)),
    )
    return refs.select(
        "spine_index", F.array_join(one, " ").alias("refs"), F.size("source_refs").cast("long").alias("n_refs")
    )


@query(
    "count_consistency",
    """SELECT book_id, 'blocks' AS measure, n AS low, n + 1 AS high, 'jsonl=' || n || ';manifest=' || (n + 1) AS detail
       FROM (SELECT book_id, count(*) AS n FROM v_blocks GROUP BY ALL) WHERE CAST(substring(book_id, 4) AS BIGINT) % 6 = 0
       UNION ALL SELECT book_id, 'chapters', filled, n, 'blocks=' || filled || ';structure=' || n FROM (
         SELECT c.book_id, count(*) AS n, count(f.spine_index) AS filled FROM v_chapters c
         LEFT JOIN (SELECT DISTINCT spine_index FROM v_blocks) f USING (spine_index) GROUP BY ALL) WHERE filled <> n""",
)
def count_consistency(spark, folder, blocks=None):
    """Manifest, structure and block counts of the same book; a sixth of the manifests is off by one."""
    blocks = base.blocks(spark, folder) if blocks is None else blocks
    counted = blocks.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    off = F.when(F.substring("book_id", 4, 9).cast("long") % 6 == 0, 1).otherwise(0)
    filled = blocks.select("book_id", "spine_index").distinct().groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    listed = base.chapters(spark, folder).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))

    def rows(df, measure, source, n):
        return df.select("book_id", F.lit(measure).alias("measure"), F.lit(source).alias("source"), n.alias("n"))

    return grounding.count_consistency(
        base.union_all(
            [
                rows(counted, "blocks", "jsonl", F.col("n")),
                rows(counted, "blocks", "manifest", (F.col("n") + off).cast("long")),
                rows(filled, "chapters", "blocks", F.col("n")),
                rows(listed, "chapters", "structure", F.col("n")),
            ]
        )
    )


@query(
    "block_rules",
    """SELECT book_id, block_id, 'chapter_out_of_range' AS code FROM v_blocks WHERE spine_index > 180
       UNION ALL SELECT book_id, block_id, 'bad_fingerprint' FROM v_blocks WHERE ord % 9 = 4""",
)
def block_rules(spark, folder, blocks=None):
    """Against a declared last chapter of 180, with some shortened fingerprints."""
    blocks = (base.blocks(spark, folder) if blocks is None else blocks).withColumn(
        "fp", F.when(F.col("ord") % 9 == 4, F.substring("fp", 1, 40)).otherwise(F.col("fp"))
    )
    limits = blocks.select("book_id").distinct().withColumn("max_spine", F.lit(180).cast("long"))
    return grounding.block_rules(blocks, limits)


view(
    "v_book_maps",
    """SELECT book_id, CASE WHEN num % 5 = 1 THEN '  ' ELSE 'What does ' || book_id || ' ask?' END AS central_question,
         CASE WHEN num % 6 = 2 THEN '' WHEN num % 6 = 4 THEN NULL ELSE first_text END AS thesis,
         CASE WHEN num % 4 = 3 THEN [] ELSE [printf('chapter_%03d', lo + 1), printf('chapter_%03d', hi + 1 + num % 3)] END AS key_chapter_ids
       FROM (SELECT book_id, CAST(substring(book_id, 4) AS BIGINT) AS num, min(spine_index) AS lo, max(spine_index) AS hi, arg_min(first_text, spine_index) AS first_text
             FROM v_analyses GROUP BY book_id) WHERE num % 10 <> 9""",
)


def book_maps(analyses):
    """Maps of the books: blank fields, missing and unknown key chapters, every tenth book without one."""
    number = F.substring("book_id", 4, 9).cast("long")
    per = analyses.groupBy("book_id").agg(
        F.min("spine_index").alias("lo"), F.max("spine_index").alias("hi"), F.min_by("summary.one_sentence", "spine_index").alias("first")
    )
    name = lambda c: F.format_string("chapter_%03d", c + 1)
    return per.where(number % 10 != 9).select(
        "book_id",
        F.when(number % 5 == 1, "  ").otherwise(F.format_string("What does %s ask?", "book_id")).alias("central_question"),
        F.when(number % 6 == 2, "").when(number % 6 != 4, F.col("first")).alias("thesis"),
        F.when(number % 4 == 3, F.array().cast("array<string>"))
        .otherwise(F.array(name(F.col("lo")), name(F.col("hi") + number % 3)))
        .alias("key_chapter_ids"),
    )


@query(
    "book_map_rules",
    """SELECT book_id, 'book_map' AS kind, id, code FROM (
         SELECT book_id, CAST(NULL AS VARCHAR) AS id, 'blank_central_question' AS code FROM v_book_maps WHERE trim(central_question) = ''
         UNION ALL SELECT book_id, NULL, 'blank_thesis' FROM v_book_maps WHERE coalesce(trim(thesis), '') = ''
         UNION ALL SELECT book_id, NULL, 'no_key_chapters' FROM v_book_maps WHERE len(key_chapter_ids) = 0
         UNION ALL SELECT m.book_id, m.id, 'unknown_key_chapter' FROM (SELECT DISTINCT book_id, unnest(key_chapter_ids) AS id FROM v_book_maps) m
           WHERE NOT EXISTS (SELECT 1 FROM v_analyses a WHERE a.book_id = m.book_id AND a.chapter_id = m.id)
         UNION ALL SELECT DISTINCT book_id, NULL, 'missing_book_map' FROM v_analyses WHERE book_id NOT IN (SELECT book_id FROM v_book_maps))""",
)
def book_map_rules(spark, folder):
    analyses = package.stored_analyses(spark, folder)
    return grounding.book_map_issues(book_maps(analyses), analyses)
