"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Input: rows with an id and a text.  Null text counts as empty, so all null and
empty texts are one group.  White space runs of 0x20 and 0x09-0x0D are equal to
one space; nothing is trimmed.  Rows with a null id never stay unless their
whole group has null ids; rows that repeat an id and its text stay or go
together.  Extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import empty_text, join_hot, stored

SPACE = r"[\x20\x09-\x0D]+"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(empty_text(column), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The text itself is part of the grouping key behind the hash, so two texts
    that collide are compared byte by byte and make two groups.  Copies meet
    map-side: a task sends one row per distinct text whatever its number of
    copies.  Back to the rows go hash, id and size only; the few hashes that a
    collision shares are joined on the text as well.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_t")).withColumn("_h", digest("_t"))
    per_text = rows.groupBy("_h", "_t").agg(F.min("_id").alias("_keep"), F.count("*").alias("_n"))
    groups = stored(per_text.groupBy("_h").agg(
        F.count("*").alias("_texts"),
        F.sum("_n").alias("_rows"),
        F.min("_keep").alias("_keep"),
    ), "hash-groups")
    total, most = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_texts"), F.lit(0))).first()
    light = rows.select("_id", "_h", F.sha2("_t", 256).alias("_s"))
    whole = groups.where("_texts = 1").select("_h", "_keep", F.col("_rows").alias("_n"))
    found = join_hot(light, whole, "_h", "_n", total)
    if most > 1:
        shared = groups.where("_texts > 1").select("_h")
        apart = stored(per_text.join(shared, "_h", "left_semi"), "collisions")
        rest = rows.join(shared, "_h", "left_semi").join(apart, ["_h", "_t"])
        found = found.unionByName(rest.select("_h", "_id", F.sha2("_t", 256).alias("_s"), "_keep", "_n"))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_s").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    gone = exact_groups(docs, id_col, text_col).where("not kept")
    gone = gone.select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha"))
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (F.sha2(normalised(text_col), 256) == gone["_sha"])
    return docs.join(gone, same, "left_anti")


