"""A book package derived from the documents: analyses with citations, concepts,
claims, entities, checkpoints and the book map.

Every block is cited once or twice by the analysis of its chapter.  A fixed
share of the citations is damaged (unknown block, range past the end, wrong
fingerprint, later chapter), and some objects break a rule, so that the checks
have something to find.  Arrays stay inside one chapter row.
"""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import actions, corpus
from lectern.plans import base
from lectern.plans.registry import view
from lectern.session import durable
from lectern.rules import blank

EMPTY_REFS = f"array<{actions.REF}>"


def _damaged_ref(b):
    h = F.col("spine_index") * 31 + b["ord"] * 7
    fp = T.fingerprint(b["text"])
    n = F.char_length(b["text"])
    tag = F.concat_ws("-", F.lit("missing"), F.col("spine_index").cast("string"), b["ord"].cast("string"))
    block = F.when(h % 11 == 0, tag).otherwise(T.stable_block_id(F.col("href"), b["ord"], fp))
    end = F.when(h % 13 == 0, n + 5).otherwise(F.least(n, F.lit(40)))
    return actions.source_ref(block, F.lit(0), end, F.when(h % 17 == 0, F.reverse(fp)).otherwise(fp))


def _of_kind(kind):
    return F.filter("items", lambda b: b["ord"] % 4 == kind)


def chapter_analyses(spark, folder):
    """Nested analysis of every content chapter."""
    items = corpus.chapter_items(base.chapters_raw(spark, folder)).where("not is_noise and size(items) > 0")
    spine = F.col("spine_index").cast("string")
    h = lambda b: F.col("spine_index") * 31 + b["ord"] * 7
    refs = lambda kind: F.transform(_of_kind(kind), _damaged_ref)

    def evidence(b):
        ref = _damaged_ref(b)
        entry = F.struct(F.substring(b["text"], 1, 40).alias("text"), ref.alias("source_ref"))
        none = F.array().cast(f"array<struct<text:string,source_ref:{actions.REF}>>")
        return F.when(h(b) % 5 == 0, none).when(h(b) % 3 == 0, F.array(entry, entry)).otherwise(F.array(entry))

    first = F.element_at("items", 1)["text"]
    joined = F.array_join(F.transform("items", lambda b: b["text"]), " ")
    return items.select(
        "book_id",
        "spine_index",
        T.chapter_id(F.col("spine_index")).alias("chapter_id"),
        "title",
        F.sha2(F.array_join(F.transform("items", lambda b: b["text"]), "\n\n"), 256).alias("source_content_hash"),
        F.struct(
            F.substring(first, 1, 80).alias("one_sentence"),
            F.when(F.col("spine_index") % 10 == 3, "  ").otherwise(F.substring(first, 1, 160)).alias("short"),
            F.substring(joined, 1, 400).alias("deep"),
            F.concat(F.lit("Chapter "), spine).alias("role_in_book"),
        ).alias("summary"),
        F.slice(F.transform("items", lambda b: F.rtrim(F.substring(b["text"], 1, 30))), 1, 3).alias("key_ideas"),
        F.array(
            F.struct(
                F.concat(F.lit("concept-"), spine).alias("concept_id"),
                F.concat(F.lit("Concept "), spine).alias("name"),
                refs(0).alias("source_refs"),
            )
        ).alias("concepts"),
        F.transform(
            _of_kind(1),
            lambda b: F.struct(
                F.concat_ws("-", F.lit("claim"), spine, b["ord"].cast("string")).alias("claim_id"),
                F.substring(b["text"], 1, 60).alias("claim"),
                evidence(b).alias("evidence"),
            ),
        ).alias("claims"),
        F.transform(
            _of_kind(2),
            lambda b: F.struct(
                F.concat(F.lit("Passage: "), F.substring(b["text"], 1, 20)).alias("explanation"),
                _damaged_ref(b).alias("source_ref"),
            ),
        ).alias("difficult_passages"),
        F.array(
            F.struct(
                F.concat(F.lit("entity-"), spine).alias("entity_id"),
                F.concat(F.lit("Entity "), spine).alias("name"),
                refs(3).alias("source_refs"),
            )
        ).alias("entities"),
        F.size("items").cast("long").alias("block_count"),
    )


def stored_analyses(spark, folder):
    """The analyses as a written table, for queries that read them several times."""
    return durable(chapter_analyses(spark, folder))


def concepts(analyses):
    """Book-level concepts, one per chapter, related to the next chapter's."""
    return analyses.select(
        "book_id",
        "spine_index",
        F.explode("concepts").alias("c"),
    ).select(
        "book_id",
        "spine_index",
        "c.concept_id",
        "c.name",
        F.col("c.source_refs").alias("appearances"),
        F.array(F.concat(F.lit("concept-"), (F.col("spine_index") + 20).cast("string"))).alias("related_ids"),
        (F.col("spine_index") % 130).alias("importance"),
        F.when(F.col("spine_index") % 3 == 0, "inferred").otherwise("grounded").alias("grounding"),
    )


def claims(analyses):
    return analyses.select("book_id", "spine_index", F.posexplode("claims").alias("pos", "c")).select(
        "book_id",
        "spine_index",
        "c.claim_id",
        "c.claim",
        F.transform("c.evidence", lambda e: e["source_ref"]).alias("evidence"),
        F.array(
            F.concat_ws(
                "-",
                F.lit("claim"),
                F.col("spine_index").cast("string"),
                (F.substring_index("c.claim_id", "-", -1).cast("long") + 4).cast("string"),
            )
        ).alias("depends_on"),
        (F.col("pos") * 7).cast("long").alias("importance"),
        F.when(F.col("pos") % 9 == 8, "inferred").otherwise("grounded").alias("grounding"),
    )


def entities(analyses):
    return analyses.select("book_id", "spine_index", F.explode("entities").alias("e")).select(
        "book_id",
        "spine_index",
        "e.entity_id",
        F.col("e.source_refs").alias("appearances"),
        F.array(F.concat(F.lit("entity-"), (F.col("spine_index") + 40).cast("string"))).alias("related_ids"),
        F.lit(50).cast("long").alias("importance"),
        F.lit("grounded").alias("grounding"),
    )


def checkpoints(analyses):
    s = F.col("spine_index")
    text = s.cast("string")
    first_ref = F.slice(F.element_at("concepts", 1)["source_refs"], 1, 1)
    question = lambda kind, n: F.struct(
        F.concat(F.lit(f"{kind}-"), n.cast("string")).alias("question_id"),
        F.concat(F.lit("Restate chapter "), text).alias("prompt"),
        F.col("key_ideas").alias("expected_points"),
    )
    card = F.struct(
        F.concat(F.lit("card-"), text).alias("flashcard_id"),
        F.col("title").alias("front"),
        F.col("summary.one_sentence").alias("back"),
        F.array(
            F.concat(F.lit("concept-"), text), F.concat(F.lit("concept-"), (s + 60).cast("string"))
        ).alias("concept_ids"),
    )
    none = F.array().cast("array<struct<question_id:string,prompt:string,expected_points:array<string>>>")
    return analyses.select(
        "book_id",
        "spine_index",
        F.concat(F.lit("checkpoint-"), text).alias("checkpoint_id"),
        F.expr("slice(array('a','b','c','d','e','f'), 1, cast(spine_index % 7 as int))").alias("must_understand"),
        # Every fiftieth chapter reuses another chapter's question id.
        F.array(question("recall", F.when(s % 50 == 10, s - 20).otherwise(s))).alias("recall_questions"),
        F.when(s % 23 == 0, none).otherwise(F.array(question("reflect", s))).alias("reflection_questions"),
        F.array(card).alias("flashcards"),
        first_ref.alias("source_refs"),
        F.when(s % 4 == 0, "inferred").otherwise("grounded").alias("grounding"),
    )


def chapter_roles(analyses):
    s = F.col("spine_index")
    copies = F.when(s % 40 == 39, 0).when(s % 60 == 5, 2).otherwise(1)
    return analyses.select(
        "book_id",
        "spine_index",
        F.explode(F.expr("array_repeat('Carries the argument.', cast(" + _sql(copies) + " as int))")).alias("role"),
        (s - 20).alias("depends_on"),
    )


def _sql(_):
    return "case when spine_index % 40 = 39 then 0 when spine_index % 60 = 5 then 2 else 1 end"


def difficulty(analyses):
    return analyses.where("spine_index % 33 <> 0").select(
        "book_id", "spine_index", F.lit("intermediate").alias("level")
    )


def reading_paths(analyses):
    """Rows (book, path, kind, chapter); every seventh book lacks the fast path."""
    number = F.substring("book_id", 4, 9).cast("long")
    paths = F.when(number % 7 == 3, F.array(F.lit("deep"), F.lit("selective"))).otherwise(
        F.array(F.lit("deep"), F.lit("fast"), F.lit("selective"))
    )
    return analyses.select("book_id", "spine_index", F.explode(paths).alias("kind")).select(
        "book_id", F.col("kind").alias("path_id"), "kind", "spine_index"
    )


def citation_rows(analyses):
    """Every citation of the analyses and the book-level documents, one row each."""
    from lectern.operators import grounding

    return grounding.all_citations(
        analyses, concepts(analyses), claims(analyses), entities(analyses), checkpoints(analyses)
    )


# --- SQL twins -------------------------------------------------------------

view(
    "v_ref_rows",
    """SELECT book_id, spine_index, ord, ord % 4 AS kind, spine_index * 31 + ord * 7 AS h,
         row_number() OVER (PARTITION BY spine_index, ord % 4 ORDER BY ord) - 1 AS idx,
         CASE WHEN (spine_index * 31 + ord * 7) % 11 = 0 THEN 'missing-' || spine_index || '-' || ord ELSE block_id END AS block_id,
         0 AS start_char,
         CASE WHEN (spine_index * 31 + ord * 7) % 13 = 0 THEN n_chars + 5 ELSE least(n_chars, 40) END AS end_char,
         CASE WHEN (spine_index * 31 + ord * 7) % 17 = 0 THEN reverse(fp) ELSE fp END AS text_fingerprint,
         printf('chapter_%03d', spine_index + 1) AS chapter_id, text FROM v_blocks""",
)
view(
    "v_claim_rows",
    """SELECT *, unnest(CASE WHEN h % 5 = 0 THEN [] WHEN h % 3 = 0 THEN [0, 1] ELSE [0] END) AS dup
       FROM v_ref_rows WHERE kind = 1""",
)
view(
    "v_chapter_cites",
    """SELECT book_id, spine_index, kind * 1000000 + ord * 10 AS seq, block_id, start_char, end_char, text_fingerprint, spine_index AS max_chapter,
         'chapters/' || chapter_id || '.analysis.json.' ||
           CASE kind WHEN 0 THEN 'concepts[0].source_refs[' || idx || ']' WHEN 2 THEN 'difficult_passages[' || idx || ']'
                     ELSE 'entities[0].source_refs[' || idx || ']' END AS path
       FROM v_ref_rows WHERE kind <> 1
       UNION ALL
       SELECT book_id, spine_index, 1000000 + ord * 10 + dup, block_id, start_char, end_char, text_fingerprint, spine_index,
         'chapters/' || chapter_id || '.analysis.json.claims[' || idx || '].evidence[' || dup || ']' FROM v_claim_rows""",
)
view(
    "v_cites",
    """SELECT book_id, path, block_id, start_char, end_char, text_fingerprint, max_chapter FROM v_chapter_cites
       UNION ALL SELECT book_id, 'concepts.json.concepts[concept-' || spine_index || '].source_refs[' || idx || ']',
         block_id, start_char, end_char, text_fingerprint, NULL FROM v_ref_rows WHERE kind = 0
       UNION ALL SELECT book_id, 'claims.json.claims[claim-' || spine_index || '-' || ord || '].supporting_evidence[' || dup || ']',
         block_id, start_char, end_char, text_fingerprint, NULL FROM v_claim_rows
       UNION ALL SELECT book_id, 'entities.json.entities[entity-' || spine_index || '].source_refs[' || idx || ']',
         block_id, start_char, end_char, text_fingerprint, NULL FROM v_ref_rows WHERE kind = 3
       UNION ALL SELECT book_id, 'checkpoints.json.checkpoints[checkpoint-' || spine_index || '].source_refs[0]',
         block_id, start_char, end_char, text_fingerprint, spine_index FROM v_ref_rows WHERE kind = 0 AND idx = 0""",
)
view(
    "v_analyses",
    """SELECT book_id, spine_index, printf('chapter_%03d', spine_index + 1) AS chapter_id, count(*) AS block_count,
         arg_min(text, ord) AS first_text, string_agg(text, ' ' ORDER BY ord) AS joined,
         sha256(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS source_content_hash,
         list_transform(list(text ORDER BY ord)[1:3], lambda t: rtrim(substring(t, 1, 30))) AS key_ideas
       FROM v_blocks GROUP BY book_id, spine_index""",
)
view(
    "v_concepts",
    """SELECT a.book_id, a.spine_index, 'concept-' || a.spine_index AS concept_id, 'Concept ' || a.spine_index AS name,
         a.spine_index % 130 AS importance, CASE WHEN a.spine_index % 3 = 0 THEN 'inferred' ELSE 'grounded' END AS grounding,
         (SELECT count(*) FROM v_ref_rows r WHERE r.spine_index = a.spine_index AND r.kind = 0) AS n_refs
       FROM v_analyses a""",
)
view(
    "v_claims",
    """SELECT book_id, spine_index, 'claim-' || spine_index || '-' || ord AS claim_id,
         'claim-' || spine_index || '-' || (ord + 4) AS depends_on, idx * 7 AS importance,
         CASE WHEN idx % 9 = 8 THEN 'inferred' ELSE 'grounded' END AS grounding, h % 5 <> 0 AS has_evidence
       FROM v_ref_rows WHERE kind = 1""",
)
view(
    "v_entities",
    """SELECT a.book_id, a.spine_index, 'entity-' || a.spine_index AS entity_id,
         (SELECT count(*) FROM v_ref_rows r WHERE r.spine_index = a.spine_index AND r.kind = 3) AS n_refs FROM v_analyses a""",
)
