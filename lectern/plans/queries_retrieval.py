"""Retrieval queries over documents and benchmark passages."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import retrieval
from lectern.plans import base
from lectern.plans.registry import query, view

view(
    "v_query_terms",
    f"SELECT item_id, unnest({base.sql_terms('text')}) AS term FROM benchmark",
)
view(
    "v_postings",
    f"SELECT book_id, spine_index, ord, block_id, unnest({base.sql_terms('text')}) AS term FROM v_blocks",
)


def benchmark_questions(spark, folder):
    return base.table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"))


@query(
    "query_terms",
    f"""SELECT item_id, len(t) AS n_terms, array_to_string(list_sort(t), ' ') AS terms
        FROM (SELECT item_id, {base.sql_terms('text')} AS t FROM benchmark)""",
)
def query_terms(spark, folder):
    terms = T.query_terms(F.col("question"))
    return benchmark_questions(spark, folder).select(
        "item_id",
        F.size(terms).cast("long").alias("n_terms"),
        F.array_join(F.array_sort(terms), " ").alias("terms"),
    )


@query(
    "document_frequency",
    """SELECT term, count(*) AS df FROM v_postings
       WHERE term IN (SELECT term FROM v_query_terms) GROUP BY term""",
)
def document_frequency(spark, folder):
    postings = retrieval.term_rows(base.blocks(spark, folder), ["block_id"])
    wanted = retrieval.term_rows(benchmark_questions(spark, folder), ["item_id"], "question")
    return retrieval.document_frequency(postings, wanted)


@query(
    "rank_blocks",
    """SELECT item_id, spine_index, ord, block_id, CAST(score AS BIGINT) AS score, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, spine_index, ord) AS rank FROM (
           SELECT item_id, spine_index, ord, block_id, sum(100000 // (df + 1)) AS score
           FROM v_postings JOIN v_query_terms USING (term)
           JOIN (SELECT term, count(*) AS df FROM v_postings GROUP BY term) USING (term)
           GROUP BY ALL) WHERE score > 0) WHERE rank <= 8""",
)
def rank_blocks(spark, folder):
    """Top eight blocks of the whole corpus for every benchmark passage."""
    return retrieval.rank_blocks(
        base.blocks(spark, folder).select("spine_index", "ord", "block_id", "text"),
        benchmark_questions(spark, folder),
        query_key="item_id",
        block_key=["block_id"],
        position=["spine_index", "ord"],
    ).select("item_id", "spine_index", "ord", "block_id", "score", "rank")
