"""Exports.  Whole-book files are written as sorted rows, never built in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import chapter_id, safe_name
from lectern.session import durable

BLOCK_ORDER = [
    "block_id", "chapter_index", "order", "kind", "text", "text_fingerprint", "heading_level", "merged_from",
    "footnote_id", "footnote_refs", "referenced_by", "image", "starts_chapter", "ends_chapter", "source_ref",
]


def block_documents(blocks: DataFrame) -> DataFrame:
    """Block rows in the fixed field order of the block document."""
    none = F.array().cast("array<string>")
    optional = {
        "heading_level": F.lit(None).cast("smallint"),
        "merged_from": none,
        "footnote_id": F.lit(None).cast("string"),
        "footnote_refs": none,
        "referenced_by": none,
        "image": F.lit(None).cast("struct<src:string,resolved_path:string,alt:string,title:string>"),
        "starts_chapter": F.lit(False),
        "ends_chapter": F.lit(False),
    }
    have = set(blocks.columns)
    fields: dict[str, Column] = {
        "chapter_index": F.col("spine_index"),
        "order": F.col("ord"),
        "text_fingerprint": F.col("fp"),
        "source_ref": F.struct(
            F.col("href").alias("chapter_href"),
            F.col("spine_index"),
            F.col("ord").alias("node_id"),
            F.lit(None).cast("string").alias("cfi"),
        ),
    }
    for name in BLOCK_ORDER:
        if name not in fields:
            fields[name] = F.col(name) if name in have else optional.get(name, F.lit("paragraph"))
    return blocks.select("book_id", *[fields[n].alias(n) for n in BLOCK_ORDER])


def _sorted_by_book(df: DataFrame, *order: str) -> DataFrame:
    """Range-partition by book and order: a large book spreads over several files, still in order."""
    return df.repartitionByRange("book_id", *order).sortWithinPartitions("book_id", *order)


def write_blocks_jsonl(blocks: DataFrame, path: str) -> None:
    rows = _sorted_by_book(block_documents(blocks), "chapter_index", "order")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("book_id").json(path)


def structure_rows(chapters: DataFrame, titles: DataFrame, toc: DataFrame) -> DataFrame:
    """Structure document as ordered rows (section, pos, json): header, chapters, spine, contents.

    titles(book_id, title), toc(book_id, pos, label, href, depth).
    """
    header = chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("spine_count"), F.sum(F.when(~F.col("is_noise"), 1).otherwise(0)).alias("chapter_count")
    )

    def part(df: DataFrame, section: int, pos: Column, *fields: str) -> DataFrame:
        json = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        return df.select("book_id", F.lit(section).alias("section"), pos.cast("long").alias("pos"), json.alias("json"))

    body = ("spine_index", "href", "title", "block_count", "first_block_id", "last_block_id", "is_noise")
    return (
        part(header.join(titles, "book_id", "left"), 0, F.lit(0), "title", "spine_count", "chapter_count")
        .unionByName(part(chapters, 1, F.col("spine_index"), *body))
        .unionByName(part(chapters.withColumn("linear", ~F.col("is_noise")), 2, F.col("spine_index"), "href", "linear"))
        .unionByName(part(toc, 3, F.col("pos"), "label", "href", "depth"))
    )


def manifest_rows(counts: DataFrame, sections: DataFrame, profile: str) -> DataFrame:
    """One manifest per book: format 0.2 exactly when it has logical sections."""
    overlaid = sections.select("book_id", F.lit(True).alias("_s")).distinct()
    return counts.join(overlaid, "book_id", "left").select(
        "book_id",
        F.when(F.col("_s"), "0.2").otherwise("0.1").alias("format_version"),
        F.lit(profile).alias("profile"),
        "source_hash",
        F.unix_timestamp().cast("string").alias("created_at"),
        "block_count",
        "chapter_count",
    )


def book_ir_rows(chapters: DataFrame, blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """Whole-book document as ordered JSON parts: toc entries, chapters, blocks (section, pos, ord, json)."""
    def part(df: DataFrame, section: int, pos: str, ord_: Column, *fields: str) -> DataFrame:
        return df.select(
            "book_id", F.lit(section).alias("section"), F.col(pos).cast("long").alias("pos"), ord_.cast("long").alias("ord"),
            F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"),
        )

    zero = F.lit(0)
    docs = block_documents(blocks)
    return (
        part(toc, 0, "pos", zero, "label", "href")
        .unionByName(part(chapters, 1, "spine_index", zero, "spine_index", "href", "title", "block_count", "is_noise"))
        .unionByName(part(docs, 2, "chapter_index", F.col("order"), *BLOCK_ORDER))
    )


def write_rows(rows: DataFrame, path: str, *order: str) -> None:
    """Ordered JSON parts, one folder per book."""
    _sorted_by_book(rows, *order).write.mode("overwrite").partitionBy("book_id").json(path)


ANALYSIS_BUCKETS = 64


def write_chapter_analyses(analyses: DataFrame, path: str) -> None:
    """One document, a JSON line, per chapter; rewriting replaces only the chapters given.

    A book's documents are dealt by chapter id over a fixed number of folders, so that
    the number of files, which the driver commits and lists, does not grow with the chapters.
    """
    spark = analyses.sparkSession
    bucket = F.pmod(F.crc32(F.coalesce("chapter_id", F.lit(""))), F.lit(ANALYSIS_BUCKETS)).cast("int").alias("bucket")
    fields = [c for c in analyses.columns if c != "book_id"]
    rows = analyses.select("book_id", bucket, "chapter_id", F.to_json(F.struct(*fields)).alias("value"))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        # The other chapters of the folders that are written again stay as they are.
        new = durable(rows)
        old = spark.read.schema("value string, book_id string, bucket int").text(path)
        old = old.withColumn("chapter_id", F.get_json_object("value", "$.chapter_id"))

        def same(names: tuple[str, ...]) -> Column:
            return reduce(Column.__and__, [old[c].eqNullSafe(given[f"_{c}"]) for c in names])

        given = new.select(*[F.col(c).alias(f"_{c}") for c in ("book_id", "bucket", "chapter_id")])
        kept = old.join(given, same(("book_id", "bucket")), "left_semi").join(given, same(("book_id", "chapter_id")), "left_anti")
        rows = durable(new.unionByName(kept))
    dealt = rows.repartitionByRange("book_id", "bucket", "chapter_id").drop("chapter_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "bucket").text(path)


def write_synthesis_documents(documents: dict[str, DataFrame], source_hash: DataFrame, version: str, path: str) -> None:
    """Each book-level table with its schema version and source hash; other books' documents stay."""
    for name, df in documents.items():
        rows = df.join(source_hash, "book_id", "left").withColumn("schema_version", F.lit(version))
        _replacing(rows).partitionBy("book_id").json(f"{path}/{name}")


def write_eval_report(stats: DataFrame, issues: DataFrame, path: str) -> None:
    """Counts and issues of the evaluated books; a book without issues loses those it had, other books keep theirs."""
    _replacing(stats).partitionBy("book_id").json(f"{path}/stats")
    clean = stats.select("book_id").distinct().join(issues.select("book_id").distinct(), "book_id", "left_anti")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in issues.schema.fields if f.name != "book_id"]
    rows = issues.withColumn("_none", F.lit(False)).unionByName(clean.select("book_id", *none, F.lit(True).alias("_none")))
    _replacing(rows).partitionBy("book_id").json(f"{path}/issues")


def read_eval_issues(spark, path: str, schema: str) -> DataFrame:
    """The issues of all books that have been evaluated."""
    return spark.read.schema(f"{schema}, _none boolean").json(f"{path}/issues").where("not _none").drop("_none")


def _replacing(df: DataFrame):
    """Writer that replaces the books it is given and no others."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def export_scope(chapters: DataFrame, requests: DataFrame, covered: DataFrame) -> DataFrame:
    """Chapters of each export: whole book, listed ones, or those read in full.

    requests(export_id, book_id, scope, chapter_ids?, session_id?); an unknown
    listed chapter is an error row.
    """
    content = chapters.where(~F.col("is_noise")).select("book_id", "spine_index")
    whole = requests.where("scope = 'whole_book'").join(content, "book_id").select("export_id", "spine_index")
    listed = (
        requests.where("scope = 'chapters'")
        .select("export_id", "book_id", F.explode("chapter_ids").alias("spine_index"))
        .join(chapters.select("book_id", "spine_index", F.lit(True).alias("_known")), ["book_id", "spine_index"], "left")
    )
    read = (
        requests.where("scope = 'read_range'")
        .join(covered.where("completed").select("session_id", "book_id", "spine_index"), ["session_id", "book_id"])
        .select("export_id", "spine_index")
    )
    ok = F.lit(None).cast("string")
    return (
        whole.withColumn("error", ok)
        .unionByName(
            listed.select(
                "export_id", "spine_index", F.when(F.col("_known").isNull(), "unknown_chapter").alias("error")
            )
        )
        .unionByName(read.withColumn("error", ok))
    )


def export_markdown(books: DataFrame, chapters: DataFrame, analyses: DataFrame, notes: DataFrame) -> DataFrame:
    """Markdown lines (book_id, section, pos, line_no, line).

    books(book_id, title, central_question, thesis); notes(book_id, spine_index,
    note_id, text).  Ordering the rows gives the file.
    """
    head = books.select(
        "book_id",
        F.lit(0).alias("section"),
        F.lit(-1).cast("long").alias("pos"),
        F.posexplode(
            F.array(
                F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("> "), "central_question"), F.lit(""),
                F.lit("## 核心主张"), F.lit(""), F.col("thesis"), F.lit(""),
            )
        ).alias("line_no", "line"),
    )
    ideas = F.transform("key_ideas", lambda i: F.concat(F.lit("- "), i))
    summary = F.concat(F.array(F.col("summary.short"), F.lit("")), ideas, F.array(F.lit("")))
    none = F.array().cast("array<string>")
    body = chapters.join(analyses.select("book_id", "spine_index", "summary", "key_ideas"), ["book_id", "spine_index"], "left")
    opening = F.array(F.concat(F.lit("## "), "title"), F.lit(""))
    lines = F.concat(opening, F.when(F.col("key_ideas").isNotNull(), summary).otherwise(none))
    sections = body.select(
        "book_id", F.lit(1).alias("section"), F.col("spine_index").alias("pos"), F.posexplode(lines).alias("line_no", "line")
    )
    noted = notes.join(chapters.select("book_id", "spine_index"), ["book_id", "spine_index"], "left_semi").select(
        "book_id",
        F.lit(1).alias("section"),
        F.col("spine_index").alias("pos"),
        F.lit(1_000_000).alias("line_no"),
        F.concat(F.lit("- 笔记："), "text").alias("line"),
    )
    return head.unionByName(sections).unionByName(noted)


def export_vault(chapters: DataFrame, analyses: DataFrame, notes: DataFrame) -> DataFrame:
    """(book_id, file_name, spine_index, content) per chapter, and index lines under Book.md."""
    noted = notes.groupBy("book_id", "spine_index").agg(
        F.array_sort(F.collect_list(F.struct("note_id", "text"))).alias("_notes")
    )
    named = (
        chapters.join(analyses.select("book_id", "spine_index", "summary", "key_ideas"), ["book_id", "spine_index"], "left")
        .join(noted, ["book_id", "spine_index"], "left")
        .withColumn("_id", chapter_id(F.col("spine_index")))
        .withColumn("_name", F.concat_ws("-", "_id", safe_name(F.col("title"))))
    )
    ideas = F.array_join(F.transform("key_ideas", lambda i: F.concat(F.lit("- "), i, F.lit("\n"))), "")
    note_lines = F.array_join(F.transform("_notes", lambda n: F.concat(F.lit("- "), n["text"], F.lit("\n"))), "")
    content = F.concat(
        F.lit("---\nbook_id: "), "book_id", F.lit("\nchapter_id: "), "_id", F.lit("\n---\n\n# "), "title", F.lit("\n\n"),
        F.when(F.col("key_ideas").isNotNull(), F.concat("summary.deep", F.lit("\n\n## Key ideas\n\n"), ideas)).otherwise(""),
        F.when(F.col("_notes").isNotNull(), F.concat(F.lit("\n## Notes\n\n"), note_lines)).otherwise(""),
    )
    files = named.select("book_id", F.concat("_name", F.lit(".md")).alias("file_name"), "spine_index", content.alias("content"))
    index = named.select(
        "book_id", F.lit("Book.md").alias("file_name"), "spine_index", F.concat(F.lit("- [["), "_name", F.lit("]]\n")).alias("content")
    )
    return files.unionByName(index)


def export_json_rows(selected: DataFrame, chapters: DataFrame, analyses: DataFrame, whole: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """JSON export parts: chapters and analyses of the selection, every other document of its books whole.

    whole: part -> (rows with book_id and spine_index, key column), e.g. concepts,
    claims, entities, checkpoints, book map, manifest and structure.
    """
    chosen = selected.select("book_id", "spine_index").distinct()
    books = chosen.select("book_id").distinct()
    keys = ["book_id", "spine_index"]

    def part(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.select("book_id", F.lit(name).alias("part"), "spine_index", F.to_json(F.struct(*fields)).alias("json"))

    rows = part(chapters.join(chosen, keys, "left_semi"), "chapters", "spine_index", "title", "href").unionByName(
        part(analyses.join(chosen, keys, "left_semi"), "chapter_analyses", "chapter_id", "summary", "key_ideas")
    )
    for name, (df, key) in whole.items():
        others = [c for c in df.columns if c not in (*keys, key)]
        rows = rows.unionByName(part(df.join(books, "book_id", "left_semi"), name, key, *others))
    return rows


def markdown_to_blocks(documents: DataFrame, key: str, text: str = "markdown", size: int = 100) -> DataFrame:
    """Non-empty lines as typed blocks, text cut at 2000 characters, in batches of ``size``."""
    lines = F.filter(F.split(F.col(text), "\r?\n"), lambda s: s != "")
    line = F.col("line")
    heading = F.regexp_extract(line, r"^(#{1,3})\s+(.+)$", 1)
    bullet = line.rlike(r"^[-*]\s+.+$")
    kind = (
        F.when(heading != "", F.concat(F.lit("heading_"), F.length(heading).cast("string")))
        .when(bullet, "bulleted_list_item")
        .otherwise("paragraph")
    )
    body = (
        F.when(heading != "", F.regexp_extract(line, r"^#{1,3}\s+(.+)$", 1))
        .when(bullet, F.regexp_extract(line, r"^[-*]\s+(.+)$", 1))
        .otherwise(F.regexp_replace(line, r"^>\s?", ""))
    )
    return documents.select(key, F.posexplode(lines).alias("pos", "line")).select(
        key,
        F.col("pos").cast("long").alias("pos"),
        F.expr(f"pos div {size}").alias("batch"),
        kind.alias("type"),
        F.substring(body, 1, 2000).alias("content"),
    )


def benchmark_report(scores: DataFrame, trials: DataFrame, *groups: str) -> DataFrame:
    """Totals of a run in one row, or in one row per group of attempts (columns of ``trials``)."""
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scores.join(trials.select("attempt_id", "call_count", *groups), "attempt_id").groupBy(*groups).agg(
        F.count(F.lit(1)).alias("attempts"),
        flag(F.col("status") == "completed").alias("completed"),
        flag(F.col("passed")).alias("structural_passes"),
        flag(F.size("hard_failures") > 0).alias("hard_failures"),
        flag(F.col("semantic_state") == "evaluated").alias("semantic_evaluated"),
        flag(F.col("task_success")).alias("task_successes"),
        F.sum("call_count").alias("calls"),
        F.when(
            F.max((F.size("hard_failures") > 0) | F.coalesce(~F.col("task_success"), F.lit(False))), "fail"
        ).otherwise("inconclusive").alias("quality"),
    )


# Columns an exported summary may carry.
SUMMARY_COLUMNS = ("attempts", "completed", "structural_passes", "hard_failures", "quality")


def export_summary(report: DataFrame) -> DataFrame:
    return report.select(*SUMMARY_COLUMNS)


def report_markdown(scores: DataFrame) -> DataFrame:
    """Table line per attempt (attempt_id, line)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return scores.select(
        "attempt_id",
        F.concat(
            F.lit("| "), "attempt_id", F.lit(" | "), "status", F.lit(" | "), text("passed"), F.lit(" | "), text("task_success"), F.lit(" |")
        ).alias("line"),
    )
