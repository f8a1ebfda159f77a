"""Citation grounding: collect citations, resolve them, report per book."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import basis_points
from lectern.functions.text import chapter_id
from lectern.rules import blank, violations
from lectern.session import broadcast_if_small

CITATION = ["book_id", "path", "block_id", "start_char", "end_char", "text_fingerprint", "max_chapter"]
LOW_COVERAGE = 5000


def _entries(prefix: Column, refs: Column, suffix: str = ".source_refs") -> Column:
    """Array of (path, ref) for an array of refs."""
    return F.transform(
        refs,
        lambda r, i: F.struct(
            F.concat(prefix, F.lit(f"{suffix}["), i.cast("string"), F.lit("]")).alias("path"), r.alias("ref")
        ),
    )


def chapter_citations(analyses: DataFrame) -> DataFrame:
    """All citations of chapter analyses; the four sections are one array, exploded once."""
    prefix = F.concat(F.lit("chapters/"), chapter_id(F.col("spine_index")), F.lit(".analysis.json."))

    def at(section: str, i: Column) -> Column:
        return F.concat(prefix, F.lit(f"{section}["), i.cast("string"), F.lit("]"))

    everything = F.concat(
        F.flatten(F.transform("concepts", lambda c, i: _entries(at("concepts", i), c["source_refs"]))),
        F.flatten(
            F.transform(
                "claims",
                lambda c, i: _entries(
                    at("claims", i), F.transform(c["evidence"], lambda e: e["source_ref"]), ".evidence"
                ),
            )
        ),
        F.transform(
            "difficult_passages",
            lambda p, i: F.struct(at("difficult_passages", i).alias("path"), p["source_ref"].alias("ref")),
        ),
        F.flatten(F.transform("entities", lambda e, i: _entries(at("entities", i), e["source_refs"]))),
    )
    return (
        analyses.select("book_id", "spine_index", F.posexplode_outer(everything).alias("seq", "x"))
        .where("x is not null")
        .select(
            "book_id",
            "spine_index",
            F.col("seq").cast("long").alias("seq"),
            "x.path",
            "x.ref.*",
            F.col("spine_index").alias("max_chapter"),
        )
    )


def _document_citations(df: DataFrame, document: str, key: str, refs: str, suffix: str, limit: Column) -> DataFrame:
    name = document.split(".")[0]
    prefix = F.concat(F.lit(f"{document}.{name}["), F.col(key), F.lit("]"))
    return (
        df.select("book_id", limit.cast("long").alias("max_chapter"), F.explode_outer(_entries(prefix, F.col(refs), suffix)).alias("x"))
        .where("x is not null")
        .select("book_id", "x.path", "x.ref.*", "max_chapter")
    )


def all_citations(
    analyses: DataFrame, concepts: DataFrame, claims: DataFrame, entities: DataFrame, checkpoints: DataFrame
) -> DataFrame:
    """Citations of all documents; chapters and checkpoints carry a chapter limit."""
    free = F.lit(None)
    parts = [
        chapter_citations(analyses).select(*CITATION),
        _document_citations(concepts, "concepts.json", "concept_id", "appearances", ".source_refs", free),
        _document_citations(claims, "claims.json", "claim_id", "evidence", ".supporting_evidence", free),
        _document_citations(entities, "entities.json", "entity_id", "appearances", ".source_refs", free),
        _document_citations(
            checkpoints, "checkpoints.json", "checkpoint_id", "source_refs", ".source_refs", F.col("spine_index")
        ),
    ]
    return reduce(DataFrame.unionByName, [p.select(*CITATION) for p in parts])


def resolve_refs(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Citations with the array of problems found against the blocks.

    A missing block stops the other checks; range, fingerprint and chapter
    limit are independent.  blocks(book_id, block_id, spine_index, n_chars, fp).
    """
    source = blocks.select(
        "book_id",
        "block_id",
        F.col("spine_index").alias("_spine"),
        F.col("n_chars").alias("_n"),
        F.col("fp").alias("_fp"),
    )
    joined = citations.join(source, ["book_id", "block_id"], "left")
    found = F.col("_spine").isNotNull()
    codes = violations(
        [
            (~found, "missing_source_ref"),
            (
                found & ((F.col("start_char") >= F.col("end_char")) | (F.col("end_char") > F.col("_n"))),
                "invalid_char_range",
            ),
            (found & (F.col("text_fingerprint") != F.col("_fp")), "fingerprint_mismatch"),
            (found & (F.col("_spine") > F.col("max_chapter")), "spoiler_boundary"),
        ]
    )
    return joined.withColumn("codes", codes).withColumn("resolved", found).drop("_spine", "_n", "_fp")


def claims_without_evidence(analyses: DataFrame, claims: DataFrame) -> DataFrame:
    """Issue rows of chapter and book claims that cite nothing."""
    prefix = F.concat(F.lit("chapters/"), chapter_id(F.col("spine_index")), F.lit(".analysis.json.claims["))
    chapter = (
        analyses.select("book_id", prefix.alias("p"), F.posexplode_outer("claims").alias("i", "c"))
        .where("c is not null and size(c.evidence) = 0")
        .select("book_id", F.concat("p", F.col("i").cast("string"), F.lit("]")).alias("path"))
    )
    book = claims.where("size(evidence) = 0").select(
        "book_id", F.concat(F.lit("claims.json.claims["), "claim_id", F.lit("]")).alias("path")
    )
    return chapter.unionByName(book).withColumn("code", F.lit("claim_without_evidence"))


def grounding_issues(resolved: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Error rows (book_id, path, code)."""
    rows = resolved.select("book_id", "path", F.explode("codes").alias("code"))
    return rows.unionByName(unsupported.select("book_id", "path", "code"))


def grounding_report(
    resolved: DataFrame, unsupported: DataFrame, analyses: DataFrame, blocks: DataFrame
) -> DataFrame:
    """One row per book: counts, coverage, validity.

    Distinct cited blocks are counted in two steps (per block, then per book),
    so a heavily cited book or block is combined before it is shuffled.
    """
    refs = resolved.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("source_ref_count"), F.sum(F.size("codes")).alias("ref_errors")
    )
    cited = (
        resolved.where("resolved")
        .select("book_id", "block_id")
        .distinct()
        .groupBy("book_id")
        .agg(F.count(F.lit(1)).alias("cited_block_count"))
    )
    missing = unsupported.groupBy("book_id").agg(F.count(F.lit(1)).alias("claim_errors"))
    done = analyses.select("book_id", "spine_index")
    analyzed = (
        blocks.join(done.distinct(), ["book_id", "spine_index"], "left_semi")
        .groupBy("book_id")
        .agg(F.count(F.lit(1)).alias("analyzed_block_count"))
    )
    books = analyses.groupBy("book_id").agg(F.count(F.lit(1)).alias("analyzed_chapter_count"))
    joined = books
    for part in (refs, cited, missing, analyzed):
        joined = joined.join(part, "book_id", "left")
    zero = F.lit(0).cast("long")
    for name in ("source_ref_count", "ref_errors", "cited_block_count", "claim_errors", "analyzed_block_count"):
        joined = joined.withColumn(name, F.coalesce(F.col(name), zero))
    errors = F.col("ref_errors") + F.col("claim_errors")
    cover = basis_points(F.col("cited_block_count"), F.col("analyzed_block_count"), empty=0)
    return joined.select(
        "book_id",
        "analyzed_chapter_count",
        "source_ref_count",
        "cited_block_count",
        "analyzed_block_count",
        cover.alias("summary_coverage_basis_points"),
        errors.alias("error_count"),
        (cover < LOW_COVERAGE).alias("low_summary_coverage"),
        (errors == 0).alias("valid"),
    )


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """(book_id, kind, id, n, code) for blank or repeated ids; ids(book_id, kind, id)."""
    counted = ids.groupBy("book_id", "kind", "id").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(blank(F.col("id")) | (F.col("n") > 1)).withColumn(
        "code", F.when(blank(F.col("id")), "blank_id").otherwise("duplicate_id")
    )


def dangling_ids(references: DataFrame, declared: DataFrame) -> DataFrame:
    """References (book_id, kind, owner, id) to ids that nobody declares."""
    return references.join(declared.select("book_id", "kind", "id").distinct(), ["book_id", "kind", "id"], "left_anti")


def exact_cover(
    analyzed: DataFrame, covering: DataFrame, subjects: tuple[str, ...] = ("role", "difficulty", "checkpoint")
) -> DataFrame:
    """Chapters not covered exactly once; analyzed(book_id, spine_index), covering adds ``subject``."""
    names = F.array(*[F.lit(s) for s in subjects])
    wanted = analyzed.select("book_id", "spine_index", F.lit(1).alias("_wanted"), F.explode(names).alias("subject"))
    counted = covering.groupBy("subject", "book_id", "spine_index").agg(F.count(F.lit(1)).alias("n"))
    return (
        wanted.join(counted, ["subject", "book_id", "spine_index"], "full_outer")
        .select("subject", "book_id", "spine_index", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "_wanted")
        .where("_wanted is null or n <> 1")
        .withColumn(
            "code",
            F.when(F.col("_wanted").isNull(), "unknown_chapter").when(F.col("n") == 0, "missing").otherwise("repeated"),
        )
        .drop("_wanted")
    )


def path_rules(books: DataFrame, paths: DataFrame) -> DataFrame:
    """Books whose reading paths are not exactly one deep, one fast and one selective."""
    kinds = paths.select("book_id", "path_id", "kind").distinct().groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )
    wanted = F.array(F.lit("deep"), F.lit("fast"), F.lit("selective"))
    return books.select("book_id").join(kinds, "book_id", "left").select(
        "book_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_paths"),
        (F.coalesce("n", F.lit(0)) == 3).__and__(F.coalesce(F.col("kinds") == wanted, F.lit(False))).alias("valid"),
    )


def synthesis_issues(concepts: DataFrame, claims: DataFrame, entities: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rule violations of the book-level objects as (book_id, kind, id, code)."""

    def rows(df: DataFrame, kind: str, key: str, rules) -> DataFrame:
        return df.select(
            "book_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.explode(violations(rules)).alias("code")
        )

    def ungrounded(refs: str) -> Column:
        return (F.col("grounding") == "grounded") & (F.size(refs) == 0)

    def bad_questions(field: str) -> Column:
        return F.exists(F.col(field), lambda q: blank(q["prompt"]))

    score = (F.col("importance") > 100, "score_out_of_range")
    parts = [
        rows(concepts, "concept", "concept_id", [score, (ungrounded("appearances"), "grounded_without_refs")]),
        rows(
            claims,
            "claim",
            "claim_id",
            [score, ((F.size("evidence") == 0) | (F.col("grounding") != "grounded"), "claim_not_grounded")],
        ),
        rows(entities, "entity", "entity_id", [score, (ungrounded("appearances"), "grounded_without_refs")]),
        rows(
            checkpoints,
            "checkpoint",
            "checkpoint_id",
            [
                (~F.size("must_understand").between(3, 5), "must_understand_count"),
                (
                    (F.size("recall_questions") == 0)
                    | (F.size("reflection_questions") == 0)
                    | (F.size("flashcards") == 0),
                    "missing_practice",
                ),
                (bad_questions("recall_questions") | bad_questions("reflection_questions"), "blank_prompt"),
                (F.exists("flashcards", lambda c: blank(c["front"]) | blank(c["back"])), "blank_flashcard"),
                (ungrounded("source_refs"), "grounded_without_refs"),
            ],
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def book_map_issues(book_maps: DataFrame, analyses: DataFrame) -> DataFrame:
    """Broken rules of the books' maps as (book_id, kind, id, code); id names an unknown chapter.

    book_maps(book_id, central_question, thesis, key_chapter_ids array<string>),
    analyses(book_id, chapter_id).  A book with analyses but without a map has
    one issue of its own.
    """
    rules = [
        (blank(F.coalesce("central_question", F.lit(""))), "blank_central_question"),
        (blank(F.coalesce("thesis", F.lit(""))), "blank_thesis"),
        (F.coalesce(F.size("key_chapter_ids"), F.lit(0)) <= 0, "no_key_chapters"),
    ]
    none = F.lit(None).cast("string")
    own = book_maps.select("book_id", none.alias("id"), F.explode(violations(rules)).alias("code"))
    analyzed = analyses.select("book_id", F.col("chapter_id").alias("id"))
    named = book_maps.select("book_id", F.explode(F.array_distinct("key_chapter_ids")).alias("id"))
    unknown = named.join(analyzed, ["book_id", "id"], "left_anti").select("book_id", "id", F.lit("unknown_key_chapter").alias("code"))
    lacking = analyses.select("book_id").distinct().join(book_maps.select("book_id"), "book_id", "left_anti")
    rows = own.unionByName(unknown).unionByName(lacking.select("book_id", none.alias("id"), F.lit("missing_book_map").alias("code")))
    return rows.select("book_id", F.lit("book_map").alias("kind"), "id", "code")


def recall_deck(checkpoints: DataFrame) -> DataFrame:
    """Recall questions, then flashcards, of every checkpoint in chapter order."""
    cards = F.concat(
        F.transform("recall_questions", lambda q: F.struct(F.lit("question").alias("kind"), q["question_id"].alias("id"))),
        F.transform("flashcards", lambda c: F.struct(F.lit("flashcard").alias("kind"), c["flashcard_id"].alias("id"))),
    )
    return checkpoints.select("book_id", "spine_index", F.posexplode(cards).alias("pos", "card")).select(
        "book_id", "spine_index", F.col("pos").cast("long").alias("pos"), "card.kind", "card.id"
    )


def chapter_refs(analyses: DataFrame) -> DataFrame:
    """Citations of a chapter sorted by block id, equal neighbours removed.

    The sort is stable, so equal refs with another ref of the same block
    between them both stay.
    """
    refs = F.concat(
        F.flatten(F.transform("concepts", lambda c: c["source_refs"])),
        F.flatten(F.transform("claims", lambda c: F.transform(c["evidence"], lambda e: e["source_ref"]))),
        F.transform("difficult_passages", lambda p: p["source_ref"]),
        F.flatten(F.transform("entities", lambda e: e["source_refs"])),
    )
    keyed = F.array_sort(
        F.transform(refs, lambda r, i: F.struct(r["block_id"].alias("k"), i.alias("i"), r.alias("r")))
    )
    sorted_refs = F.transform(keyed, lambda x: x["r"])
    return analyses.withColumn("_sorted", sorted_refs).withColumn(
        "source_refs",
        F.filter("_sorted", lambda r, i: (i == 0) | (r != F.get(F.col("_sorted"), i - 1))),
    ).drop("_sorted")


def same_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows only left, rows only right (multiset comparison on row digests)."""
    columns = left.columns

    def digested(df: DataFrame, l_count: int, r_count: int) -> DataFrame:
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        return df.select(*keys, row.alias("_row"), F.lit(l_count).alias("_l"), F.lit(r_count).alias("_r"))

    zero = F.lit(0).cast("long")
    return (
        digested(left, 1, 0)
        .unionByName(digested(right.select(*columns), 0, 1))
        .groupBy(*keys, "_row")
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        .groupBy(*keys)
        .agg(
            F.sum(F.greatest(F.col("_l") - F.col("_r"), zero)).alias("only_left"),
            F.sum(F.greatest(F.col("_r") - F.col("_l"), zero)).alias("only_right"),
        )
    )


def count_consistency(counts: DataFrame) -> DataFrame:
    """Mismatches between counts of the same thing; counts(book_id, measure, source, n)."""
    return (
        counts.groupBy("book_id", "measure")
        .agg(
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source", F.col("n").cast("string")))), ";").alias(
                "detail"
            ),
        )
        .where("low <> high")
    )


def block_rules(blocks: DataFrame, chapter_limit: DataFrame) -> DataFrame:
    """Malformed block rows: blank id, bad fingerprint, chapter out of range."""
    from lectern.rules import issue_rows

    limit = broadcast_if_small(chapter_limit.select("book_id", "max_spine"))
    rules = [
        (blank(F.col("block_id")), "blank_block_id"),
        (~F.col("fp").rlike("^[0-9a-fA-F]{64}$"), "bad_fingerprint"),
        (F.col("spine_index") > F.col("max_spine"), "chapter_out_of_range"),
    ]
    return issue_rows(blocks.join(limit, "book_id", "left"), ["book_id", "block_id"], rules)
