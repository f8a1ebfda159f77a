"""The given tables seen as books: sources are books, documents are chapters,
lines are blocks.  Every function here is a narrow projection of a scan, so the
derived tables cost no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans.registry import view
from lectern.session import durable, spread

# The corpus repeats these first lines as site furniture; they extend the fixed
# noise titles so that the rule has chapters to act on.
SITE_TITLES = ("the and attion to thanedble the, anea. eriner thanea.", "ietzte.")
TITLES = T.NOISE_TITLES + SITE_TITLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chapters_raw(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")
    first = T.normalise_whitespace(F.substring_index("text", "\n", 1))
    return docs.select(
        F.col("source").alias("book_id"),
        F.col("doc_id").alias("spine_index"),
        F.format_string("text/doc-%d.xhtml", "doc_id").alias("href"),
        F.rtrim(F.substring(first, 1, 60)).alias("title"),
        "text",
    ).withColumn("is_noise", T.is_noise_title(F.col("title"), TITLES))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line, in order, blank lines included."""
    return chapters_raw(spark, folder).select(
        "book_id", "spine_index", "href", "title", "is_noise", F.posexplode(F.split("text", "\n")).alias("ord", "raw")
    ).withColumn("ord", F.col("ord").cast("long"))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Retained, normalised blocks with stable ids; noise chapters have none."""
    rows = lines(spark, folder).where(~F.col("is_noise")).withColumn("text", T.normalise_whitespace(F.col("raw")))
    return with_identity(rows.where("text <> ''").drop("raw", "is_noise", "title"))


def stored_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks as a written table, for queries that read them several times."""
    return durable(blocks(spark, folder))


def with_identity(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("fp", T.fingerprint(F.col("text")))
        .withColumn("block_id", T.stable_block_id(F.col("href"), F.col("ord"), F.col("fp")))
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    return chapters_raw(spark, folder).drop("text")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- SQL twins -------------------------------------------------------------

_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_norm(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{_SPACE}', ' ', 'g'))"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_noise(title: str, titles=TITLES) -> str:
    prefixes = " OR ".join(f"starts_with(lower({title}), '{t}:')" for t in titles)
    return f"(lower({title}) IN ({sql_list(titles)}) OR {prefixes})"


def sql_terms(expr: str) -> str:
    """Distinct retrieval terms (plain words and bigrams of words with CJK)."""
    words = f"list_transform(string_split_regex({expr}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: lower(w))"
    pairs = "list_transform(range(1, length(w)), lambda i: substring(w, i, 2))"
    has_cjk = "regexp_matches(w, '[\\x{3400}-\\x{9fff}]')"
    keep = f"strlen(w) > 1 AND NOT list_contains([{sql_list(T.STOP_WORDS)}], w)"
    return (
        f"list_distinct(flatten(list_transform({words}, lambda w: CASE WHEN {has_cjk} THEN {pairs} "
        f"WHEN {keep} THEN [w] ELSE [] END)))"
    )


view(
    "v_chapters",
    f"""SELECT *, {sql_noise('title')} AS is_noise FROM (
  SELECT source AS book_id, doc_id AS spine_index, 'text/doc-' || doc_id || '.xhtml' AS href,
         rtrim(substring({sql_norm("string_split(text, chr(10))[1]")}, 1, 60)) AS title, text FROM documents)""",
)
view(
    "v_lines",
    """SELECT book_id, spine_index, href, title, is_noise, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM v_chapters""",
)
view(
    "v_blocks",
    f"""SELECT *, left(sha256(href || '|' || ord || '|' || fp), 32) AS block_id, length(text) AS n_chars FROM (
  SELECT *, sha256(text) AS fp FROM (
    SELECT book_id, spine_index, href, ord, {sql_norm('raw')} AS text FROM v_lines WHERE NOT is_noise)
  WHERE text <> '')""",
)
