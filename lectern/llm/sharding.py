"""Sampled splitters: size-weighted key samples give range boundaries; ranges are laid end to end into shards.

Input: rows with an id and a text.  A row weighs the UTF-8 bytes of its text
(null: none) plus 1, so empty texts have a place too.  Equal texts are neighbours
in key order (hash of the text, then id) and meet in one shard unless a shard
ends among them.  Null ids sort first; rows that repeat id and text are equal
keys, ordered arbitrarily but each with its own slot.  Extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

DRAWS, SAMPLE = 200, 1_000_000  # expected sample draws per range, fewer (20 at least) where they would exceed the sample


def splitters(keys: DataFrame, ranges: int, total: int) -> list[tuple[int, int]]:
    """At most ``ranges`` - 1 keys (h, id) that cut the weight into near-equal parts.

    A row is drawn ``size * rate`` times on average, by a hash of its key, so a
    lost task draws the same rows again.  The size of the sample follows the
    number of ranges, not that of the rows.
    """
    draws = max(20, min(DRAWS, SAMPLE // ranges))
    rate = min(1.0, ranges * draws / max(1, total))
    chance = (F.xxhash64("h", "id", F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    sample = keys.withColumn("w", F.floor(F.col("size") * F.lit(rate) + chance)).where("w > 0")
    # Equal keys count once, with all their weight, so a repeated key is one boundary at most.
    sample = sample.groupBy("h", "id").agg(F.sum("w").alias("w"))
    before = F.sum("w").over(Window.orderBy("h", "id")) - F.col("w")
    cut = sample.select("h", "id", before.alias("before"), F.sum("w").over(Window.partitionBy()).alias("all"))
    part = F.floor(F.col("before") * F.lit(ranges) / F.col("all"))
    rows = cut.groupBy(part.alias("part")).agg(F.min(F.struct("h", "id")).alias("k")).where("part > 0").orderBy("k")
    return [(r["k"]["h"], r["k"]["id"]) for r in rows.collect()]


def range_of(h: Column, ident: Column, cuts: list[tuple[int, int]]):
    """Number of boundaries at or below the key, as a chain of binary-search steps (name, column)."""
    n = len(cuts)
    if n == 0:
        return [("r", F.lit(0))]
    hs, ids = F.array(*[F.lit(a).cast("long") for a, _ in cuts]), F.array(*[F.lit(b).cast("long") for _, b in cuts])
    steps, at = [], F.lit(0)
    power = 1 << (n.bit_length() - 1)
    while power:
        probe = at + F.lit(power)
        inside = F.least(probe, F.lit(n))
        bh, bi = F.element_at(hs, inside), F.element_at(ids, inside)
        low = (bh < h) | ((bh == h) & F.coalesce(bi <= ident, bi.isNull()))
        at_next = F.when((probe <= n) & low, probe).otherwise(at)
        name = f"r{power}"
        steps.append((name, at_next))
        at = F.col(name)
        power >>= 1
    return steps + [("r", at)]


def byte_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 250_000,
    least_ranges: int = 64,
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Ranges grow in number with the table, so each is a bounded window.  A range
    that turns out to hold over twice its share is subdivided by a hash of its
    ids.  Ranges end to end give each row its exact byte position; the shard is
    the eighth in which the middle of the row lies, so shards differ by less than
    two rows' bytes.
    """
    text = F.col(text_col).cast("string")
    keys = stored(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("crc"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        ),
        "shard-keys",
    )
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(least_ranges, -(-rows // rows_per_range))
    cuts = splitters(keys, ranges, total)
    dealt = reduce(lambda df, s: df.withColumn(*s), range_of(F.col("h"), F.col("id"), cuts), keys)
    dealt = dealt.select("id", "size", "crc", "h", "r")
    load = dealt.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    load = load.withColumn(
        "pieces",
        F.greatest(F.ceil(F.col("bytes") * ranges / (2 * F.lit(max(1, total)))), F.ceil(F.col("n") / F.lit(4 * rows_per_range)))
        .cast("int"),
    )
    overfull = {r["r"]: r["pieces"] for r in load.where("pieces > 1").select("r", "pieces").collect()}  # <= ranges rows
    piece = F.lit(0)
    if overfull:
        wanted = F.create_map(*[F.lit(x) for pair in sorted(overfull.items()) for x in pair])
        spread = F.xxhash64("id", "crc", F.lit(5))
        piece = F.coalesce(F.pmod(spread, F.try_element_at(wanted, F.col("r"))), F.lit(0)).cast("int")
    dealt = dealt.withColumn("p", piece)
    cell = Window.partitionBy("r", "p").orderBy("h", "id")
    inside = dealt.withColumn("before", F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    inside = inside.withColumn("nth", F.row_number().over(cell).cast("long") - 1)
    # One row per cell: a few for every range.
    per_cell = dealt.groupBy("r", "p").agg(F.sum("size").alias("cell_bytes"), F.count("*").alias("cell_rows"))
    along = Window.orderBy("r", "p").rowsBetween(Window.unboundedPreceding, -1)
    start = per_cell.select(
        "r", "p",
        F.coalesce(F.sum("cell_bytes").over(along), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("cell_rows").over(along), F.lit(0)).alias("row0"),
    )
    middle = F.col("byte0") + F.col("before") + F.col("size") / 2
    placed = inside.join(F.broadcast(start), ["r", "p"]).select(
        "id", "size", "crc",
        F.least(F.floor(middle * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("row0") + F.col("nth")).alias("row"),
    )
    placed = stored(placed, "shard-rows")
    first = placed.groupBy("shard").agg(F.min("row").alias("row1"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("row1")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
