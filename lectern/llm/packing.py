"""Concatenate and cut: all documents end to end, in windows of a fixed number of tokens.

Input: rows with an id and a text.  Null and empty texts are documents of the end
token alone.  Ids may be null or repeat; each row is a document of its own.
Extra columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import empty_text, stored
from lectern.llm.tokens import coder, default_path

END = 2
TOKENS = "id long, part int, before long, n long, wide boolean, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table of documents: ids as bytes, their number, and the tokens before them in their task (first pass)."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, part, before = coder(path), TaskContext.get().partitionId(), 0
        size, last = code.type.itemsize, np.array([end], code.type).tobytes()
        for batch in batches:
            ids = [code.ids(t) + last for t in batch["text"]]
            n = np.array([len(x) // size for x in ids], np.int64)
            ends = before + np.cumsum(n)
            yield pd.DataFrame(
                {"id": batch["id"], "part": part, "before": ends - n, "n": n, "wide": size == 4, "ids": ids}
            )
            before = int(ends[-1]) if len(ends) else before

    rows = docs.select(F.col(id_col).cast("long").alias("id"), empty_text(text_col).alias("text"))
    return stored(rows.mapInPandas(_nullable(run), TOKENS), "token-ids")


def _nullable(run):
    """Pandas holds a column with nulls as floats; ids go through as objects."""

    def safe(batches):
        for out in run(batches):
            ids = out["id"]
            out["id"] = ids.map(lambda x: None if pd.isna(x) else int(x)).astype("Int64") if ids.dtype.kind == "f" else ids
            yield out

    return safe


def pack(docs: DataFrame, window: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Totals of the first pass's tasks, summed along their numbers, give every
    document its place in the whole; a document that crosses a window's end has a
    record in each window.  All windows but the last are full.
    """
    tokens = encode(docs, path, id_col=id_col, text_col=text_col)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # one row per task of the first pass
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(along), F.lit(0)).alias("first"))
    placed = tokens.join(F.broadcast(starts), "part")
    placed = placed.select("id", (F.col("first") + F.col("before")).alias("at"), "n", "wide", "ids")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, at, n, wide, raw in batch.itertuples(index=False):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                doc = None if doc is None or doc != doc else int(doc)
                edges = [0, *range(window - at % window, n, window), n]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    rows.append((doc, a, b - a, zlib.crc32(ids[a:b]), n, (at + a) // window, (at + a) % window))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return placed.mapInPandas(cut, PIECES)
