"""Section overlay queries: a table of contents derived from the documents."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import sections
from lectern.plans import base
from lectern.plans.registry import query, view
from lectern.session import durable

# One leaf per content chapter start and per fifth line.  By book number mod 9:
# 4 has a leaf to nowhere, 5 lists its leaves backwards, 6 only chapter starts,
# 7 has an unknown anchor, 8 skips its first chapter's start.
view(
    "v_toc",
    """SELECT book_id, CASE WHEN num % 9 = 5 THEN 100000000000000 - spine_index * 100000 - ord ELSE spine_index * 100000 + ord END AS pos,
         rtrim(substring(text, 1, 20)) AS label,
         'doc-' || CASE WHEN num % 9 = 4 AND ord = lo AND spine_index % 40 < 20 THEN 'x' ELSE '' END || spine_index || '.xhtml' ||
           CASE WHEN ord = lo THEN '' WHEN num % 9 = 7 AND ord % 25 = 10 THEN '#none' ELSE '#l' || ord END AS href
       FROM (SELECT *, CAST(substring(book_id, 4) AS BIGINT) AS num, min(ord) OVER (PARTITION BY spine_index) AS lo FROM v_blocks)
       WHERE (ord = lo OR (ord % 5 = 0 AND num % 9 <> 6)) AND NOT (num % 9 = 8 AND spine_index < 20)
       UNION ALL SELECT book_id, spine_index * 100000, 'noise', 'doc-' || spine_index || '.xhtml' FROM v_chapters WHERE is_noise""",
)


def toc_leaves(spark, folder, blocks=None):
    from pyspark.sql import Window

    num = F.substring("book_id", 4, 9).cast("long")
    blocks = base.blocks(spark, folder) if blocks is None else blocks
    lines = blocks.select("book_id", "spine_index", "ord", F.substring("text", 1, 20).alias("label"))
    rows = lines.withColumn("num", num).withColumn("lo", F.min("ord").over(Window.partitionBy("spine_index")))
    at = F.col("spine_index") * 100_000 + F.col("ord")
    head = F.col("ord") == F.col("lo")
    lost = (F.col("num") % 9 == 4) & head & (F.col("spine_index") % 40 < 20)
    leaves = rows.where((head | ((F.col("ord") % 5 == 0) & (F.col("num") % 9 != 6))) & ~((F.col("num") % 9 == 8) & (F.col("spine_index") < 20)))
    named = leaves.select(
        "book_id",
        F.when(F.col("num") % 9 == 5, F.lit(100_000_000_000_000) - at).otherwise(at).alias("pos"),
        F.rtrim("label").alias("label"),
        F.concat(
            F.lit("doc-"),
            F.when(lost, "x").otherwise(""),
            F.col("spine_index").cast("string"),
            F.lit(".xhtml"),
            F.when(head, "")
            .when((F.col("num") % 9 == 7) & (F.col("ord") % 25 == 10), "#none")
            .otherwise(F.concat(F.lit("#l"), F.col("ord").cast("string"))),
        ).alias("href"),
    )
    noise = base.chapters(spark, folder).where("is_noise").select(
        "book_id",
        (F.col("spine_index") * 100_000).alias("pos"),
        F.lit("noise").alias("label"),
        F.format_string("doc-%d.xhtml", "spine_index").alias("href"),
    )
    return named.unionByName(noise)


def anchors(spark, folder, blocks=None):
    blocks = base.blocks(spark, folder) if blocks is None else blocks
    return blocks.select(
        "book_id", "href", F.concat(F.lit("l"), F.col("ord").cast("string")).alias("fragment"), "ord", "block_id"
    )


view(
    "v_matched",
    """SELECT t.book_id, t.pos, t.label, t.href AS toc_href, count(c.spine_index) AS matches,
         CASE WHEN count(c.spine_index) = 1 THEN min(c.spine_index) END AS spine_index, bool_or(c.is_noise) AS is_noise
       FROM v_toc t LEFT JOIN v_chapters c ON c.book_id = t.book_id
         AND (c.href = string_split(t.href, '#')[1] OR ends_with(c.href, '/' || string_split(t.href, '#')[1]))
       GROUP BY ALL""",
)


@query("toc_to_chapter", "SELECT book_id, pos, matches, spine_index FROM v_matched")
def toc_to_chapter(spark, folder):
    return sections.toc_to_chapter(toc_leaves(spark, folder), base.chapters(spark, folder)).select(
        "book_id", "pos", "matches", "spine_index"
    )


@query("anchor_to_block", "SELECT book_id, href, 'l' || ord AS fragment, ord, block_id FROM v_blocks")
def anchor_to_block(spark, folder):
    return sections.anchor_to_block(anchors(spark, folder))


view(
    "v_positions",
    "SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY spine_index, ord) - 1 AS position FROM v_blocks",
)
view(
    "v_starts",
    """SELECT m.book_id, m.pos, m.label, p.position, p.spine_index, p.ord, p.lo FROM v_matched m LEFT JOIN
         (SELECT *, min(ord) OVER (PARTITION BY spine_index) AS lo FROM v_positions) p ON p.spine_index = m.spine_index
         AND ((contains(m.toc_href, '#') AND 'l' || p.ord = string_split(m.toc_href, '#')[2]) OR (NOT contains(m.toc_href, '#') AND p.ord = p.lo))
       WHERE m.matches = 1 AND NOT m.is_noise""",
)
view(
    "v_rejected",
    """SELECT book_id FROM v_matched WHERE matches <> 1 UNION SELECT book_id FROM v_starts WHERE position IS NULL
       UNION SELECT book_id FROM (SELECT book_id, position <= lag(position) OVER (PARTITION BY book_id ORDER BY pos) AS bad FROM v_starts) WHERE bad""",
)
view(
    "v_sections",
    """SELECT book_id, row_number() OVER w - 1 AS section_index, title, position AS start_position,
         coalesce(lead(position) OVER w, size) AS end_position FROM (
         SELECT book_id, label AS title, position, ord = lo AS head FROM v_starts WHERE book_id NOT IN (SELECT book_id FROM v_rejected)
         UNION ALL SELECT book_id, 'Front matter', 0, true FROM v_starts WHERE book_id NOT IN (SELECT book_id FROM v_rejected)
           GROUP BY book_id HAVING min(position) > 0)
       JOIN (SELECT book_id, count(*) AS size, count(DISTINCT spine_index) AS filled FROM v_blocks GROUP BY book_id) USING (book_id)
       WHERE book_id NOT IN (
         SELECT book_id FROM (SELECT book_id, count(*) AS n, bool_and(ord = lo) AS heads, min(position) AS first FROM v_starts GROUP BY book_id)
         JOIN (SELECT book_id, count(DISTINCT spine_index) AS filled FROM v_blocks GROUP BY book_id) USING (book_id)
         WHERE heads AND n + CASE WHEN first > 0 THEN 1 ELSE 0 END = filled)
       WINDOW w AS (PARTITION BY book_id ORDER BY position)""",
)


def built(spark, folder, blocks=None):
    blocks = base.stored_blocks(spark, folder) if blocks is None else blocks
    return sections.build_sections(
        toc_leaves(spark, folder, blocks), base.chapters(spark, folder), blocks, anchors(spark, folder, blocks)
    )


@query("rejected_overlays", "SELECT book_id FROM v_rejected")
def rejected_overlays(spark, folder):
    blocks = base.stored_blocks(spark, folder)
    matched = durable(sections.toc_to_chapter(toc_leaves(spark, folder, blocks), base.chapters(spark, folder)))
    positions = durable(sections.block_positions(blocks.select("book_id", "spine_index", "ord")))
    starts = durable(sections.section_starts(matched, positions, sections.anchor_to_block(anchors(spark, folder, blocks))))
    return sections.rejected_books(matched, starts)


@query(
    "section_ranges",
    """SELECT book_id, section_index, printf('chapter_%03d', section_index + 1) AS chapter_id, title, start_position, end_position FROM v_sections""",
)
def section_ranges(spark, folder):
    return built(spark, folder)


view(
    "v_section_blocks",
    """SELECT p.*, s.section_index, s.title, p.position - s.start_position AS section_ord
       FROM v_positions p JOIN v_sections s ON s.book_id = p.book_id AND p.position >= s.start_position AND p.position < s.end_position""",
)


@query("section_blocks", "SELECT book_id, section_index, section_ord, block_id FROM v_section_blocks")
def section_blocks(spark, folder):
    blocks = base.stored_blocks(spark, folder)
    return sections.section_blocks(built(spark, folder, blocks), blocks).select(
        "book_id", "section_index", "section_ord", "block_id"
    )


@query(
    "analysis_view",
    """SELECT book_id, section_index, printf('chapter_%03d', section_index + 1) AS chapter_id, title, count(*) AS block_count,
         arg_min(block_id, position) AS first_block_id, arg_max(block_id, position) AS last_block_id, arg_min(href, position) AS href,
         CAST(sum(n_chars) AS BIGINT) AS n_chars FROM v_section_blocks GROUP BY ALL""",
)
def analysis_view(spark, folder):
    blocks = base.stored_blocks(spark, folder)
    parts = built(spark, folder, blocks)
    return sections.analysis_view(sections.section_blocks(parts, blocks), parts)


@query(
    "partition_check",
    """SELECT book_id, 'block_not_in_section' AS code, count(*) AS n FROM v_section_blocks WHERE ord % 16 = 15 GROUP BY ALL
       UNION ALL SELECT book_id, 'unknown_or_moved_block', count(*) FROM v_section_blocks WHERE ord % 16 = 7 GROUP BY ALL""",
)
def partition_check(spark, folder, blocks=None):
    """Sections that lost some of their blocks and moved some to another chapter."""
    blocks = base.stored_blocks(spark, folder) if blocks is None else blocks
    parts = built(spark, folder, blocks)
    claimed = (
        sections.section_blocks(parts, blocks)
        .where("ord % 16 <> 15")
        .withColumn("spine_index", F.when(F.col("ord") % 16 == 7, F.col("spine_index") + 1).otherwise(F.col("spine_index")))
    )
    return sections.partition_check(parts, claimed.drop("ord"), blocks)


view(
    "v_tree",
    """SELECT source AS book_id, doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS label, title, href
       FROM documents JOIN v_chapters ON doc_id = spine_index""",
)


@query(
    "dedupe_toc",
    """SELECT book_id, 1 AS depth, min(doc_id) * 10 AS pos, arg_min(label, doc_id) AS label, lang || '.xhtml' AS href, CAST(NULL AS VARCHAR) AS parent
       FROM v_tree WHERE doc_id % 10 <> 9 GROUP BY book_id, lang
       UNION ALL SELECT book_id, 2, doc_id * 10 + 1, title, href, first FROM (
         SELECT *, 'p' || (min(doc_id) FILTER (doc_id % 10 <> 9) OVER (PARTITION BY book_id, lang)) AS first FROM v_tree) WHERE doc_id % 10 <> 9 AND title <> ''""".replace(
        "1 AS depth", "CAST(1 AS BIGINT) AS depth"
    ),
)
def dedupe_toc(spark, folder):
    """Every document lists its language and, below it, itself; the languages repeat."""
    docs = base.table(spark, folder, "documents").select(F.col("doc_id").alias("spine_index"), "lang")
    rows = base.chapters(spark, folder).join(docs, "spine_index")
    text = F.col("spine_index").cast("string")
    gone = F.col("spine_index") % 10 == 9
    parents = rows.select(
        "book_id",
        F.concat(F.lit("p"), text).alias("node"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(1).alias("depth"),
        (F.col("spine_index") * 10).alias("pos"),
        F.when(gone, " ").when(F.col("spine_index") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("label"),
        F.concat("lang", F.lit(".xhtml")).alias("href"),
    )
    children = rows.select(
        "book_id",
        F.concat(F.lit("c"), text).alias("node"),
        F.concat(F.lit("p"), text).alias("parent"),
        F.lit(2).alias("depth"),
        (F.col("spine_index") * 10 + 1).alias("pos"),
        F.col("title").alias("label"),
        "href",
    )
    return sections.dedupe_toc(parents.unionByName(children), 2).drop("node")


@query(
    "split_href",
    "SELECT book_id, pos, string_split(href, '#')[1] AS path, CASE WHEN contains(href, '#') THEN string_split(href, '#')[2] END AS fragment FROM v_toc",
)
def split_href(spark, folder):
    return toc_leaves(spark, folder).select(
        "book_id", "pos", T.href_path(F.col("href")).alias("path"), T.href_fragment(F.col("href")).alias("fragment")
    )
