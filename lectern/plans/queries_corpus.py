"""Corpus normalisation queries over documents."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import corpus
from lectern.plans import base
from lectern.plans.base import sql_norm
from lectern.plans.registry import query, view
from lectern.session import durable

# The corpus repeats its furniture in about a tenth of a book's chapters; the
# operator's default ratio of 3/5 is checked on a fixture in tests/.
RATIO = (1, 10)

view(
    "v_edges",
    """SELECT book_id, spine_index, unnest(list_distinct([arg_min(fp, ord), arg_max(fp, ord)])) AS fp
       FROM v_blocks WHERE n_chars BETWEEN 1 AND 160 GROUP BY book_id, spine_index""",
)
view(
    "v_repeated",
    """SELECT book_id, fp, chapters FROM
         (SELECT book_id, fp, count(*) AS chapters FROM v_edges GROUP BY ALL)
         JOIN (SELECT book_id, count(*) AS n FROM v_chapters WHERE NOT is_noise GROUP BY book_id) USING (book_id)
       WHERE n >= 2 AND chapters >= greatest(2, (n * 1 + 9) // 10)""",
)
view(
    "v_kept",
    """SELECT b.*, row_number() OVER (PARTITION BY spine_index ORDER BY ord) AS pos FROM v_blocks b
       WHERE NOT EXISTS (SELECT 1 FROM v_repeated r JOIN v_edges e USING (book_id, fp)
                         WHERE e.spine_index = b.spine_index AND r.book_id = b.book_id AND r.fp = b.fp)""",
)
view(
    "v_merge_steps",
    """SELECT spine_index, pos, ord, ord AS start_ord, length(text) AS cur_len, text FROM v_kept WHERE pos = 1
       UNION ALL
       SELECT spine_index, pos, ord, CASE WHEN joined THEN prev_start ELSE ord END,
              CASE WHEN joined THEN prev_len + 1 + length(text) ELSE length(text) END, text
       FROM (SELECT p.spine_index, p.pos, p.ord, p.text, m.start_ord AS prev_start, m.cur_len AS prev_len,
               m.cur_len <= 1200 AND NOT regexp_matches(m.text, '[.!?:;。！？：；]$')
               AND (regexp_matches(p.text, '^\\p{Ll}') OR regexp_matches(m.text, '[，、]$')) AS joined
             FROM v_merge_steps m JOIN v_kept p ON p.spine_index = m.spine_index AND p.pos = m.pos + 1)""",
    recursive=True,
)
view(
    "v_merged",
    """SELECT k.book_id, k.spine_index, k.href, m.start_ord AS ord, string_agg(k.text, ' ' ORDER BY k.ord) AS text,
              CASE WHEN count(*) > 1 THEN string_agg(k.block_id, ',' ORDER BY k.ord) ELSE '' END AS merged_from
       FROM v_merge_steps m JOIN v_kept k ON k.spine_index = m.spine_index AND k.ord = m.ord
       GROUP BY k.book_id, k.spine_index, k.href, m.start_ord""",
)
view(
    "v_normal",
    """SELECT *, sha256(text) AS fp, left(sha256(href || '|' || ord || '|' || sha256(text)), 32) AS block_id,
         row_number() OVER (PARTITION BY spine_index ORDER BY ord) = 1 AS starts_chapter,
         row_number() OVER (PARTITION BY spine_index ORDER BY ord DESC) = 1 AS ends_chapter FROM v_merged""",
)
view(
    "v_chapter_rows",
    """SELECT c.book_id, c.spine_index, c.href, c.title, c.is_noise, count(n.block_id) AS block_count,
         coalesce(string_agg(n.text, chr(10) || chr(10) ORDER BY n.ord), '') AS visible_text,
         arg_min(n.block_id, n.ord) AS first_block_id, arg_max(n.block_id, n.ord) AS last_block_id
       FROM v_chapters c LEFT JOIN v_normal n USING (spine_index) GROUP BY ALL""",
)


def items(spark, folder):
    return corpus.chapter_items(base.chapters_raw(spark, folder))


def normal_chapters(spark, folder):
    return corpus.normalise(items(spark, folder), *RATIO)


def normal_blocks(spark, folder):
    return corpus.explode_blocks(normal_chapters(spark, folder))


@query("normalise_whitespace", f"SELECT spine_index, ord, {sql_norm('raw')} AS text FROM v_lines")
def normalise_whitespace(spark, folder):
    return base.lines(spark, folder).select(
        "spine_index", "ord", T.normalise_whitespace(F.col("raw")).alias("text")
    )


@query("block_identity", "SELECT spine_index, ord, block_id, fp AS text_fingerprint FROM v_blocks")
def block_identity(spark, folder):
    return base.blocks(spark, folder).select("spine_index", "ord", "block_id", F.col("fp").alias("text_fingerprint"))


@query(
    "chapter_ids",
    """SELECT spine_index, printf('chapter_%03d', spine_index + 1) AS chapter_id, spine_index + 1 AS chapter_number,
              CAST(NULL AS BIGINT) AS malformed FROM v_chapters""",
)
def chapter_ids(spark, folder):
    return base.chapters(spark, folder).select(
        "spine_index",
        T.chapter_id(F.col("spine_index")).alias("chapter_id"),
        T.chapter_number(T.chapter_id(F.col("spine_index"))).alias("chapter_number"),
        T.chapter_number(F.col("href")).alias("malformed"),
    )


@query("noise_chapters", "SELECT book_id, spine_index, title, is_noise FROM v_chapters")
def noise_chapters(spark, folder):
    return base.chapters(spark, folder).select("book_id", "spine_index", "title", "is_noise")


@query(
    "drop_blank_blocks",
    f"""SELECT spine_index, count(*) AS authored, count(*) FILTER ({sql_norm('raw')} <> '') AS kept
        FROM v_lines WHERE NOT is_noise GROUP BY spine_index""",
)
def drop_blank_blocks(spark, folder):
    return base.chapters_raw(spark, folder).where(~F.col("is_noise")).select(
        "spine_index",
        F.size(F.split("text", "\n")).cast("long").alias("authored"),
        F.size(F.filter(F.split("text", "\n"), lambda t: T.normalise_whitespace(t) != ""))
        .cast("long")
        .alias("kept"),
    )


@query("edge_candidates", "SELECT book_id, spine_index, fp FROM v_edges")
def edge_candidates(spark, folder):
    return items(spark, folder).select(
        "book_id", "spine_index", F.explode(corpus.edge_fingerprints(F.col("items"))).alias("fp")
    )


@query("repeated_boundary_lines", "SELECT book_id, fp, chapters FROM v_repeated")
def repeated_boundary_lines(spark, folder):
    return corpus.repeated_boundary_lines(items(spark, folder), *RATIO)


@query("boundary_line_removal", "SELECT spine_index, ord, text FROM v_kept")
def boundary_line_removal(spark, folder):
    chapters = durable(items(spark, folder))
    kept = corpus.drop_boundary_lines(chapters, corpus.repeated_boundary_lines(chapters, *RATIO))
    return kept.select("spine_index", F.explode("items").alias("b")).select("spine_index", "b.ord", "b.text")


@query(
    "merge_paragraphs",
    "SELECT book_id, spine_index, ord, text, block_id, merged_from FROM v_normal",
)
def merge_paragraphs(spark, folder):
    return normal_blocks(spark, folder).select(
        "book_id", "spine_index", "ord", "text", "block_id", F.array_join("merged_from", ",").alias("merged_from")
    )


@query("chapter_edges", "SELECT spine_index, block_id, starts_chapter, ends_chapter FROM v_normal")
def chapter_edges(spark, folder):
    return normal_blocks(spark, folder).select("spine_index", "block_id", "starts_chapter", "ends_chapter")


@query(
    "visible_text",
    """SELECT spine_index, block_count, sha256(visible_text) AS content_hash, length(visible_text) AS n_chars,
              first_block_id, last_block_id FROM v_chapter_rows""",
)
def visible_text(spark, folder):
    return corpus.chapter_rows(normal_chapters(spark, folder)).select(
        "spine_index",
        "block_count",
        "content_hash",
        F.char_length("visible_text").cast("long").alias("n_chars"),
        "first_block_id",
        "last_block_id",
    )


@query(
    "structure_counts",
    """SELECT book_id, count(*) AS spine_count, count(*) FILTER (NOT is_noise) AS content_chapters,
              CAST(sum(block_count) AS BIGINT) AS block_count,
              arg_min(first_block_id, spine_index) FILTER (block_count > 0) AS first_block_id,
              arg_max(last_block_id, spine_index) FILTER (block_count > 0) AS last_block_id
       FROM v_chapter_rows GROUP BY book_id""",
)
def structure_counts(spark, folder):
    return corpus.structure_counts(corpus.chapter_rows(normal_chapters(spark, folder)))


@query(
    "analyzable_chapters",
    "SELECT book_id, spine_index, block_count FROM v_chapter_rows WHERE NOT is_noise AND block_count > 0",
)
def analyzable_chapters(spark, folder):
    from lectern.operators import analysis

    # A filter on the block count would otherwise be pushed below, with a second
    # copy of the whole normalisation; the chapter table is written first.
    stored = durable(
        corpus.chapter_rows(normal_chapters(spark, folder)).select("book_id", "spine_index", "is_noise", "block_count")
    )
    return analysis.analyzable_chapters(stored).select(
        "book_id", "spine_index", "block_count"
    )


@query(
    "safe_name",
    r"""SELECT spine_index, substring(regexp_replace(regexp_replace(title, '[^\p{L}\p{M}\p{N}_-]', '-', 'g'),
              '^-+|-+$', '', 'g'), 1, 80) AS safe,
              regexp_full_match(href, '[A-Za-z0-9_-]+') AS href_is_id, regexp_full_match(book_id, '[A-Za-z0-9_-]+') AS book_is_id
       FROM v_chapters""",
)
def safe_name(spark, folder):
    return base.chapters(spark, folder).select(
        "spine_index",
        T.safe_name(F.col("title")).alias("safe"),
        T.valid_id(F.col("href")).alias("href_is_id"),
        T.valid_id(F.col("book_id")).alias("book_is_id"),
    )


@query(
    "placeholder_chapters",
    "SELECT book_id, spine_index, count(block_id) AS block_count FROM v_chapters LEFT JOIN v_blocks USING (book_id, spine_index) GROUP BY ALL",
)
def placeholder_chapters(spark, folder):
    spine = base.chapters(spark, folder).select("book_id", "spine_index", "href")
    parsed = items(spark, folder).where(~F.col("is_noise")).select("book_id", "spine_index", "title", "items")
    return corpus.placeholder_chapters(spine, parsed).select(
        "book_id", "spine_index", F.size("items").cast("long").alias("block_count")
    )


@query(
    "plain_terms",
    r"""SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(
          string_split_regex(text, '[^\p{L}\p{M}\p{N}]+'), lambda w: length(w) > 1), lambda w: lower(w)))), ' ') AS terms
        FROM benchmark""",
)
def plain_terms(spark, folder):
    return base.table(spark, folder, "benchmark").select(
        "item_id", F.array_join(F.array_sort(T.plain_terms(F.col("text"))), " ").alias("terms")
    )


@query(
    "clip_and_slice",
    "SELECT spine_index, ord, substring(text, 1, 18) AS clipped, substring(text, 6, 12) AS sliced FROM v_blocks",
)
def clip_and_slice(spark, folder):
    return base.blocks(spark, folder).select(
        "spine_index",
        "ord",
        T.clip(F.col("text"), 18).alias("clipped"),
        T.slice_text(F.col("text"), F.lit(5), F.lit(17)).alias("sliced"),
    )
