"""Corpus normalisation.

A chapter is one row that carries its blocks as an ordered array, because that
is how documents arrive.  Chapter-local steps (edge candidates, boundary-line
removal, paragraph merging, chapter edges) are array expressions inside the row
and never shuffle text; only per-book counters cross the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.session import durable

MERGE_LIMIT = 1200
EDGE_LIMIT = 160
# Characters that end a paragraph for good, and soft CJK breaks.
HARD_END = "[.!?:;。！？：；]$"
SOFT_END = "[，、]$"


def gather_blocks(blocks: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Block rows back to one row per chapter (groups are one chapter each)."""
    return blocks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ord", *[f for f in fields if f != "ord"]))).alias("items")
    )


def chapter_items(chapters: DataFrame, text: str = "text", kind: str = "paragraph") -> DataFrame:
    """Split chapter text into an array of normalised, non-blank blocks."""
    cleaned = F.filter(
        F.transform(
            F.split(F.col(text), "\n"),
            lambda line, i: F.struct(
                i.cast("long").alias("ord"), F.lit(kind).alias("kind"), T.normalise_whitespace(line).alias("text")
            ),
        ),
        lambda item: item["text"] != "",
    )
    empty = F.array().cast("array<struct<ord:bigint,kind:string,text:string>>")
    return chapters.withColumn("items", F.when(F.col("is_noise"), empty).otherwise(cleaned)).drop(text)


def edge_fingerprints(items: Column) -> Column:
    """Fingerprints of the first and last blocks with 1..160 characters."""
    short = F.filter(items, lambda b: F.char_length(T.normalise_whitespace(b["text"])).between(1, EDGE_LIMIT))
    return _with(
        short,
        lambda s: F.when(
            F.size(s) > 0,
            F.array_distinct(F.array(T.fingerprint(F.element_at(s, 1)["text"]), T.fingerprint(F.element_at(s, -1)["text"]))),
        ).otherwise(F.array().cast("array<string>")),
    )


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however the optimizer copies the columns it stands in."""
    return F.transform(F.array(value), use)[0]


def repeated_boundary_lines(chapters: DataFrame, numerator: int = 3, denominator: int = 5) -> DataFrame:
    """(book_id, fp, chapters): edge lines of at least max(2, ceil(ratio * n)) content chapters.

    A chapter contributes at most two fingerprints, so a book has at most
    2 / ratio of them however long it is.
    """
    # One extra null entry per chapter counts the chapters in the same pass.
    entries = F.concat(edge_fingerprints(F.col("items")), F.array(F.lit(None).cast("string")))
    counted = durable(
        chapters.where(~F.col("is_noise"))
        .select("book_id", F.explode_outer(entries).alias("fp"))
        .groupBy("book_id", "fp")
        .agg(F.count(F.lit(1)).alias("chapters"))
        .where("chapters >= 2")
    )
    sizes = counted.where("fp is null").select("book_id", F.col("chapters").alias("n"))
    counted = counted.where("fp is not null")
    threshold = F.expr(f"(n * {numerator} + {denominator - 1}) div {denominator}")
    return counted.join(sizes, "book_id").where(F.col("chapters") >= threshold).drop("n")


def drop_boundary_lines(chapters: DataFrame, repeated: DataFrame) -> DataFrame:
    """Remove every block whose fingerprint is repeated and an edge of that chapter."""
    per_book = durable(repeated.groupBy("book_id").agg(F.collect_set("fp").alias("repeated")))
    joined = chapters.join(per_book, "book_id", "left")
    gone = F.array_intersect(F.coalesce("repeated", F.array().cast("array<string>")), edge_fingerprints(F.col("items")))
    # A filter that the optimizer derives from ``items`` would compute ``gone`` anew for every block.
    kept = lambda g: F.filter("items", lambda b: ~F.array_contains(g, T.fingerprint(b["text"])))
    items = _with(gone, lambda g: F.when(F.size(g) > 0, kept(g)).otherwise(F.col("items")))
    return joined.withColumn("items", items).drop("repeated")


def _joins(previous: Column, following: Column) -> Column:
    return (
        (previous["kind"] == "paragraph")
        & (following["kind"] == "paragraph")
        & ~previous["text"].rlike(HARD_END)
        & (following["text"].rlike(r"^\p{IsLowercase}") | previous["text"].rlike(SOFT_END))
    )


def merge_paragraphs(chapters: DataFrame) -> DataFrame:
    """Join paragraphs that were split mid-sentence.

    The join test depends on the neighbours only, except for the length cap on
    the text merged so far.  Runs of joinable neighbours are found first; the
    sequential fold then works inside a run, not over the chapter.
    """
    item = "struct<ord:bigint,kind:string,text:string,merged_from:array<string>>"
    items = F.transform(
        "items",
        lambda b: F.struct(
            b["ord"].alias("ord"),
            b["kind"].alias("kind"),
            b["text"].alias("text"),
            F.array(T.stable_block_id(F.col("href"), b["ord"], T.fingerprint(b["text"]))).alias("merged_from"),
        ).cast(item),
    )
    n = F.size("items")
    base = chapters.withColumn("items", items)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | ~_joins(F.get("items", i - 1), F.get("items", i)),
    )

    def fold(run: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            last = F.element_at(acc, -1)
            merged = F.struct(
                last["ord"].alias("ord"),
                last["kind"].alias("kind"),
                F.concat_ws(" ", last["text"], x["text"]).alias("text"),
                F.concat(last["merged_from"], x["merged_from"]).alias("merged_from"),
            ).cast(item)
            return F.when(
                F.char_length(last["text"]) > MERGE_LIMIT, F.concat(acc, F.array(x))
            ).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged)))

        return F.when(F.size(run) == 1, run).otherwise(
            F.aggregate(F.slice(run, F.lit(2), F.size(run) - 1), F.slice(run, F.lit(1), F.lit(1)), step)
        )

    runs = F.transform(
        "starts",
        lambda s, k: F.slice(
            F.col("items"), s + 1, F.coalesce(F.get("starts", k + 1), F.size("items")) - s
        ),
    )
    return (
        base.withColumn("starts", F.when(n > 0, starts).otherwise(F.array().cast("array<int>")))
        .withColumn(
            "items",
            F.when(F.size("starts") == F.size("items"), F.col("items")).otherwise(F.flatten(F.transform(runs, fold))),
        )
        .drop("starts")
        .withColumn(
            "items",
            F.transform(
                "items",
                lambda b: b.withField(
                    "merged_from",
                    F.when(F.size(b["merged_from"]) > 1, b["merged_from"]).otherwise(
                        F.array().cast("array<string>")
                    ),
                ),
            ),
        )
    )


def explode_blocks(chapters: DataFrame) -> DataFrame:
    """Block rows with ids, fingerprints and chapter-edge flags.

    The outer form of explode keeps Catalyst from inferring a filter on the
    array and pushing a second copy of its whole expression below.
    """
    rows = chapters.select(
        "book_id", "spine_index", "href", F.size("items").alias("_n"), F.posexplode_outer("items").alias("_pos", "b")
    ).where("_pos is not null")
    fields = rows.select(
        "book_id",
        "spine_index",
        "href",
        F.col("b.ord").alias("ord"),
        F.col("b.kind").alias("kind"),
        F.col("b.text").alias("text"),
        F.col("b.merged_from").alias("merged_from"),
        (F.col("_pos") == 0).alias("starts_chapter"),
        (F.col("_pos") == F.col("_n") - 1).alias("ends_chapter"),
    )
    return fields.withColumn("fp", T.fingerprint(F.col("text"))).withColumn(
        "block_id", T.stable_block_id(F.col("href"), F.col("ord"), F.col("fp"))
    )


def chapter_rows(chapters: DataFrame) -> DataFrame:
    """Chapter table from chapters with items: counts, visible text, hash, edges."""
    first, last = F.element_at("items", 1), F.element_at("items", -1)
    text = F.array_join(F.transform("items", lambda b: b["text"]), "\n\n")

    def identity(b: Column) -> Column:
        return F.when(
            F.size("items") > 0, T.stable_block_id(F.col("href"), b["ord"], T.fingerprint(b["text"]))
        )

    return chapters.select(
        "book_id",
        "spine_index",
        "href",
        T.normalise_whitespace(F.col("title")).alias("title"),
        "is_noise",
        F.size("items").cast("long").alias("block_count"),
        text.alias("visible_text"),
        T.fingerprint(text).alias("content_hash"),
        identity(first).alias("first_block_id"),
        identity(last).alias("last_block_id"),
    )


def normalise(chapters: DataFrame, numerator: int = 3, denominator: int = 5) -> DataFrame:
    """Boundary lines out, paragraphs merged; chapters with items in and out."""
    repeated = repeated_boundary_lines(chapters, numerator, denominator)
    return merge_paragraphs(drop_boundary_lines(chapters, repeated))


def structure_counts(chapter_table: DataFrame) -> DataFrame:
    """Per book: spine, chapter and block counts, first and last block id."""
    has = F.col("block_count") > 0
    return chapter_table.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("spine_count"),
        F.sum(F.when(~F.col("is_noise"), 1).otherwise(0)).alias("content_chapters"),
        F.sum("block_count").alias("block_count"),
        F.min_by("first_block_id", F.when(has, F.col("spine_index"))).alias("first_block_id"),
        F.max_by("last_block_id", F.when(has, F.col("spine_index"))).alias("last_block_id"),
    )


def heading_levels(headings: DataFrame) -> DataFrame:
    """Authored levels of a book (1..6) to dense ranks, at most 6.

    Reduced to at most six rows per book before the window.
    """
    levels = headings.select("book_id", F.least(F.greatest("level", F.lit(1)), F.lit(6)).cast("long").alias("level"))
    rank = F.least(F.dense_rank().over(Window.partitionBy("book_id").orderBy("level")), F.lit(6)).cast("long")
    return levels.distinct().withColumn("normalised_level", rank)


def link_footnotes(links: DataFrame, blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Footnote links resolved both ways: (book, chapter, source id, note id).

    links(book_id, spine_index, node_id, fragment), blocks(.., node_id,
    block_id), notes(.., note_id, block_id).  Self links are dropped.
    """
    keys = ["book_id", "spine_index"]
    source = blocks.select(*keys, "node_id", F.col("block_id").alias("source_block_id"))
    target = notes.select(*keys, F.col("note_id").alias("fragment"), F.col("block_id").alias("note_block_id"))
    return (
        links.where(F.col("fragment").isNotNull())
        .join(source, [*keys, "node_id"])
        .join(target, [*keys, "fragment"])
        .where("source_block_id <> note_block_id")
        .select(*keys, "source_block_id", "note_block_id")
        .distinct()
    )


def placeholder_chapters(spine: DataFrame, documents: DataFrame) -> DataFrame:
    """Spine items without a parsed document become empty chapters."""
    empty = F.array().cast("array<struct<ord:bigint,kind:string,text:string>>")
    return spine.join(documents, ["book_id", "spine_index"], "left").select(
        "book_id",
        "spine_index",
        F.coalesce(spine["href"], F.lit("")).alias("href"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("items", empty).alias("items"),
    )


def spine_hrefs(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine idref to manifest href; an unknown idref keeps a null href."""
    items = manifest.select("book_id", F.col("id").alias("idref"), "href", "media_type")
    return spine.join(items, ["book_id", "idref"], "left")
