"""Verbatim runs: every run of RUN words or more that occurs twice, wherever lines and sentences end.

The anchor of a window of RUN words is the smallest hash of the runs of GRAM words
in it, so equal windows have equal anchors at equal places.  About one word in 16
is an anchor.  Places of an anchor whose whole surroundings are equal are one
class, of which all but the first repeat it; only one place of each class is
compared with other classes of the anchor, by the hashes of all its windows.  No
pair of places is formed, and every step is a minimum per hash, combined map-side.

Words are those of ``words_of``.  Texts of fewer than RUN words have no runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import empty_text, forget, join_hot, mixed, stored

RUN, GRAM = 50, 20
SIDE = RUN - GRAM  # words before an anchor that a window around it reaches; behind its first word RUN
CHUNK = 200_000  # words hashed at once
CELL = 32  # words; windows that begin so near one another overlap
BROADCAST_ANCHORS = 1_000_000  # anchors (8 bytes each) that may be sent to every executor
BROADCAST_IDS = 2_000_000

BASE = 0x9E3779B97F4A7C15
SPAN = ("s", "e", "sc", "ec", "p0", "p1")  # words from s to e, characters from sc to ec, paragraphs p0 to p1
NEXT = ("cn", "pn")  # character and paragraph of word s + RUN, where a window may begin that does not overlap the first one


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, np.uint64(BASE)), np.full(n + 1, np.uint64(pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Chunk:
    """Words of texts one after another, with hashes of any of their runs."""

    def __init__(self, texts: list[str], paragraphs):
        hashes, chars, ends, lines, self.first_line = [], [], [], [], [0]
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            words = data.lower().split()
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            raw = np.frombuffer(data, np.uint8)
            inside = np.r_[False, (raw != 32) & ((raw < 9) | (raw > 13)), False]
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters before each byte
            chars.append(before[edges[::2]])
            ends.append(before[edges[1::2]])
            starts = np.array([a for a, _ in paragraphs(text)])
            lines.append(np.searchsorted(starts, chars[-1], "right") - 1)
        self.lengths = np.array([len(h) for h in hashes], np.int64)
        self.chars, self.ends, self.lines = np.concatenate(chars), np.concatenate(ends), np.concatenate(lines)
        self.stop = np.cumsum(self.lengths)
        self.start = self.stop - self.lengths
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        n = len(self.text)
        up, self.down = _powers(n)
        self.sums = np.r_[np.uint64(0), np.cumsum(np.concatenate(hashes) * up[:n], dtype=np.uint64)]

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows inside a text, the place of each one's anchor, and the hashes of all runs of GRAM words."""
        n = len(self.text)
        at = np.arange(n - GRAM + 1)
        grams = self.hashes(at, at + GRAM)
        best, width = at, 1
        while width < SIDE + 1:
            step = min(width, SIDE + 1 - width)
            a, b = best[: len(best) - step], best[step:]
            best = np.where(grams[b] <= grams[a], b, a)
            width += step
        whole = np.flatnonzero(self.text[: n - RUN + 1] == self.text[RUN - 1 :])
        return whole, best[whole], grams

    def frame(self, rows: list[tuple], s: np.ndarray, e: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
        """Spans with the (doc_id, t) of their texts."""
        own = self.text[s]
        base = self.start[own]
        ids = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        spans = (s - base, e - base, self.chars[s], self.ends[e - 1], self.lines[s], self.lines[e - 1])
        after = np.minimum(s + RUN, self.stop[own] - 1)
        spans = (*spans, self.chars[after], self.lines[after])
        return pd.DataFrame({"doc_id": ids[0][own], "t": ids[1][own], **more, **dict(zip(SPAN + NEXT, spans, strict=True))})


def chunks(batches: Iterator[pd.DataFrame], paragraphs) -> Iterator[tuple[list[tuple], Chunk]]:
    """Rows (doc_id, t, ..., text) with enough words, and their words."""
    for batch in batches:
        rows, size = [], 0
        for row in batch.itertuples(index=False):
            words = len(row.text.encode("utf-8", "surrogatepass").split())
            if words >= RUN:
                rows.append(tuple(row))
                size += words
            if size > CHUNK:
                yield rows, Chunk([r[-1] for r in rows], paragraphs)
                rows, size = [], 0
        if rows:
            yield rows, Chunk([r[-1] for r in rows], paragraphs)


def place(*more: str) -> Column:
    return F.struct("doc_id", "t", *SPAN, *NEXT, *more)


def anchor_places(texts: DataFrame, paragraphs) -> DataFrame:
    """Stored (doc_id, t, v, ctx, at, span): every anchor with its surroundings, from SIDE words before it to RUN after its first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, chunk in chunks(batches, paragraphs):
            _, best, grams = chunk.anchors()
            at = np.unique(best)
            own = chunk.text[at]
            s, e = np.maximum(at - SIDE, chunk.start[own]), np.minimum(at + RUN, chunk.stop[own])
            ctx = mixed(chunk.hashes(s, e) ^ ((at - s) * 128 + (e - at)).astype(np.uint64))
            yield chunk.frame(
                rows, s, e, v=grams[at].astype(np.int64), ctx=ctx.astype(np.int64), at=at - chunk.start[own]
            )

    schema = "doc_id long, t long, v long, ctx long, at int, s int, e int, sc int, ec int, p0 int, p1 int, cn int, pn int"
    return stored(texts.select("doc_id", "t", "text").mapInPandas(run, schema), "run-anchors")


def window_places(texts: DataFrame, wanted: DataFrame, paragraphs) -> DataFrame:
    """Stored (doc_id, t, h, span): the windows of the wanted (doc_id, t, anchors)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, chunk in chunks(batches, paragraphs):
            whole, best, _ = chunk.anchors()
            some = np.concatenate([np.asarray(r[2], np.int64) + a for r, a in zip(rows, chunk.start, strict=True)])
            s = whole[np.isin(best, some)]
            yield chunk.frame(rows, s, s + RUN, h=chunk.hashes(s, s + RUN).astype(np.int64))

    ids = wanted.select("doc_id").distinct()
    small = ids.count() <= BROADCAST_IDS
    rows = texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "t"])
    rows = rows.join(wanted.hint("merge"), ["doc_id", "t"]).select("doc_id", "t", "anchors", "text")
    schema = "doc_id long, t long, h long, s int, e int, sc int, ec int, p0 int, p1 int, cn int, pn int"
    return stored(rows.mapInPandas(run, schema), "run-windows")


def _later(rows: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Places of a hash but the first, with the first; where windows of both overlap in one text, what follows the first window."""
    heads = heads.select(key, "first", "m").where("m > 1")
    total = heads.agg(F.coalesce(F.sum("m"), F.lit(1))).first()[0]
    both = join_hot(rows.select(key, "doc_id", "t", *SPAN), heads, key, "m", total)
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    both = both.where(~(own & (F.col("s") == F.col("first.s"))))
    inside = own & (F.col("s") < F.col("first.s") + RUN)
    cut = {"s": F.col("first.s") + RUN, "sc": F.col("first.cn"), "p0": F.col("first.pn")}
    both = both.select(
        "doc_id", "t", *[(F.when(inside, cut[c]).otherwise(F.col(c)) if c in cut else F.col(c)).alias(c) for c in SPAN],
        F.struct("first.doc_id", "first.t", *[f"first.{c}" for c in SPAN]).alias("first"),
    )
    return both.where("s < e")


def _aligned(rows: DataFrame) -> DataFrame:
    """Later windows with their first ones, up to CELL neighbours of one alignment as one row.

    Windows whose first ones begin within CELL words overlap, and so do the first ones, hence
    their union is one span.  Windows that were cut keep a row each.
    """
    first = F.col("first")
    cut = F.col("e") - F.col("s") < RUN
    cell = F.when(cut, F.col("s")).otherwise(F.floor(first["s"] / CELL)).cast("long")
    ends = [F.min(c).alias(c) for c in ("s", "sc", "p0")] + [F.max(c).alias(c) for c in ("e", "ec", "p1")]
    firsts = [F.min(f"first.{c}").alias(f"f{c}") for c in ("s", "sc", "p0")] + [F.max(f"first.{c}").alias(f"f{c}") for c in ("e", "ec", "p1")]
    keys = [first["doc_id"].alias("fdoc"), first["t"].alias("ft"), (F.col("e") - first["e"]).alias("shift"), cut.alias("cut"), cell.alias("cell")]
    whole = rows.groupBy("doc_id", "t", *keys).agg(*ends, *firsts)
    named = F.struct(F.col("fdoc").alias("doc_id"), F.col("ft").alias("t"), *[F.col(f"f{c}").alias(c) for c in SPAN])
    return whole.select("doc_id", "t", *SPAN, named.alias("first"))


def _united(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, span, s0): overlapping spans of a text with the start of their union."""
    # Characters and paragraphs grow with the words of a text, so each end is taken for itself.
    rows = rows.groupBy(*by, "s").agg(
        F.max("e").alias("e"), F.max("ec").alias("ec"), F.max("p1").alias("p1"), F.min("sc").alias("sc"), F.min("p0").alias("p0"),
        F.count("*").alias("m"),
    )
    order = Window.partitionBy(*by).orderBy("s")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(before.isNull() | (F.col("s") > before), F.col("s")))
    return rows.withColumn("s0", F.max("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _unions(rows: DataFrame, by: list[str]) -> DataFrame:
    first, last = [F.min(c).alias(c) for c in ("s", "sc", "p0")], [F.max(c).alias(c) for c in ("e", "ec", "p1")]
    return rows.groupBy(*by, "s0").agg(*first, *last).select(*by, *SPAN)


def repeated_runs(docs: DataFrame, paragraphs, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored (passage_id, doc_id, span) of the repeating places, and of the first place of each passage.

    Every window of RUN words that occurs before, in the order of id and place, lies
    in a repeating place.  A passage is what its first text has in one piece.
    """
    text = empty_text(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).where("doc_id is not null")
    anchors = anchor_places(texts, paragraphs)
    shared = stored(anchors.groupBy("v").agg(F.count("*").alias("members")).where("members > 1"), "shared-anchors")
    if shared.count() <= BROADCAST_ANCHORS:
        rows = anchors.join(F.broadcast(shared.select("v")), "v", "left_semi")
    else:
        total = shared.agg(F.sum("members")).first()[0]
        rows = join_hot(anchors, shared, "v", "members", total).drop("members")
    rows = stored(rows, "shared-anchor-places")
    forget(anchors, shared)
    heads = stored(rows.groupBy("ctx").agg(F.first("v").alias("v"), F.min(place("at")).alias("first"), F.count("*").alias("m")), "anchor-classes")
    several = stored(heads.groupBy("v").agg(F.count("*").alias("classes")).where("classes > 1"), "open-anchors")
    total = several.agg(F.coalesce(F.sum("classes"), F.lit(1))).first()[0]
    wanted = join_hot(heads.select("v", "first"), several, "v", "classes", total)
    wanted = wanted.select("first.doc_id", "first.t", "first.at").groupBy("doc_id", "t").agg(F.collect_set("at").alias("anchors"))
    wanted = stored(wanted, "wanted-anchors")
    windows = window_places(texts, wanted, paragraphs)
    firsts = stored(windows.groupBy("h").agg(F.min(place()).alias("first"), F.count("*").alias("m")).where("m > 1"), "window-classes")
    later = stored(_later(rows, heads, "ctx").unionByName(_aligned(_later(windows, firsts, "h"))), "later-places")
    forget(rows, heads, several, wanted, windows, firsts)

    pieces = _united(later.select("first.*"), ["doc_id", "t"])
    pieces = pieces.withColumn("passage_id", F.shiftrightunsigned(F.xxhash64("doc_id", "t", "s0"), 1))
    pieces = stored(pieces, "first-pieces")
    origin = stored(_unions(pieces, ["passage_id", "doc_id", "t"]), "first-places")
    named = pieces.select(F.xxhash64("doc_id", "t", "s").alias("k"), "passage_id", "m")
    total = named.agg(F.coalesce(F.sum("m"), F.lit(1))).first()[0]
    key = F.xxhash64("first.doc_id", "first.t", "first.s").alias("k")
    repeats = join_hot(later.select(key, "doc_id", "t", *SPAN), named, "k", "m", total).drop("m")
    by = ["passage_id", "doc_id", "t"]
    repeats = stored(_unions(_united(repeats, by), by), "run-places")
    forget(later, pieces)
    return repeats, origin
