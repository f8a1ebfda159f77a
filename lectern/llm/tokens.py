"""Token ids of whole texts with a public tokenizer file, and the exact length histogram of a corpus."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WordTable, empty_text, stored

# Latin letters of one code point, then marks without an apostrophe: such a word
# is one run of letters and one run of marks for the tokenizer.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?%$#&*()|\[\]]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if printable, else 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}


class Coder:
    """Ids of a text.

    A tokenizer that drops white space never joins two words, so each word is
    encoded once per worker and looked up afterwards; the result is that of
    encoding the whole text.  Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str, length_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        probe = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        self.by_word = probe("ab cd\nef") == probe("ab") + probe("cd") + probe("ef") and not probe(" \n ")
        # The short cut for plain words is that of a lower-casing byte-level vocabulary; checked, not assumed.
        self.letters = byte_letters()
        self.cores = WordTable(self._run)
        samples = ["Hello", "ÀÉé", "été.,", "xqzzj!?", "Straße(", "%%%"]
        self.short_cut = False
        if self.by_word:
            self.short_cut = True
            self.short_cut = all(self._ids(w) == np.asarray(probe(w), self.type).tobytes() for w in samples)
        self.words = WordTable((lambda w: len(self._ids(w)) // self.type.itemsize) if length_only else self._ids)

    def _run(self, run: str) -> bytes:
        mapped = run.lower().encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(mapped)], self.type).tobytes()

    def _ids(self, word: str) -> bytes:
        if not word:
            return b""
        if self.short_cut and (m := PLAIN.fullmatch(word)):
            a, b = m.groups()
            return (self.cores[a] if a else b"") + (self.cores[b] if b else b"")
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.type).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self._ids(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def length(self, text: str) -> int:
        if not self.by_word:
            return len(self._ids(text)) // self.type.itemsize
        return sum(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def coder(path: str, length_only: bool = False) -> Coder:
    """One per worker process: its word table serves all tasks of that worker."""
    return Coder(path, length_only)


def token_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens of every whole text; null and empty texts have 0."""
    path = path or default_path()
    return docs.select(F.col(id_col).alias("id"), _length_udf(path)(empty_text(text_col)).alias("n_tokens"))


def _length_udf(path: str):
    import pandas as pd

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        code = coder(path, True)
        for texts in batches:
            yield pd.Series([code.length(t) for t in texts], dtype="int64")

    lengths.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(lengths, "long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens", bucket: int = 1024) -> DataFrame:
    """One row per distinct encoded length, with sums over all shorter and all longer documents.

    Columns: n_tokens, n_docs (of that length), docs_up_to, tokens_up_to,
    docs_longer, tokens_longer, total_docs, total_tokens, and for a context limit
    of that length kept_tokens (total after truncation) and cut_tokens.  Any limit
    between two lengths is answered from the row below it (``at_limits``).  Null
    lengths count as 0; an empty table gives no rows.

    Documents meet as counts per length, combined map-side.  Sums run inside
    buckets of lengths, and one row per bucket runs along all lengths.
    """
    counts = lengths.groupBy(F.coalesce(F.col(column), F.lit(0)).cast("long").alias("n_tokens")).agg(
        F.count("*").alias("n_docs")
    )
    counts = counts.withColumn("b", F.floor(F.col("n_tokens") / bucket)).withColumn("t", F.col("n_docs") * F.col("n_tokens"))
    counts = stored(counts, "length-counts")
    per = counts.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    along, whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select(
        "b",
        F.coalesce(F.sum("bd").over(along), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("bt").over(along), F.lit(0)).alias("t0"),
        F.sum("bd").over(whole).alias("total_docs"),
        F.sum("bt").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("b").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(per, "b").select(
        "n_tokens",
        "n_docs",
        (F.col("d0") + F.sum("n_docs").over(within)).alias("docs_up_to"),
        (F.col("t0") + F.sum("t").over(within)).alias("tokens_up_to"),
        "total_docs",
        "total_tokens",
    )
    longer = F.col("total_docs") - F.col("docs_up_to")
    tokens = F.col("total_tokens") - F.col("tokens_up_to")
    return rows.select(
        "*",
        longer.alias("docs_longer"),
        tokens.alias("tokens_longer"),
        (F.col("tokens_up_to") + longer * F.col("n_tokens")).alias("kept_tokens"),
        (tokens - longer * F.col("n_tokens")).alias("cut_tokens"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_cut, kept_tokens, cut_tokens) for given limits of 0 or more, from the histogram alone."""
    least = F.lit(0)
    exprs = []
    for i, x in enumerate(limits):
        n = F.col("n_tokens")
        over = F.greatest(n - x, least) * F.col("n_docs")
        exprs += [
            F.coalesce(F.sum(F.when(n > x, F.col("n_docs"))), least).alias(f"d{i}"),
            F.coalesce(F.sum(over), least).alias(f"c{i}"),
            F.coalesce(F.sum(n * F.col("n_docs") - over), least).alias(f"k{i}"),
        ]
    one = histogram.agg(*exprs)
    parts = [
        F.struct(
            F.lit(int(x)).cast("long").alias("context_limit"),
            F.col(f"d{i}").cast("long").alias("docs_cut"),
            F.col(f"k{i}").cast("long").alias("kept_tokens"),
            F.col(f"c{i}").cast("long").alias("cut_tokens"),
        )
        for i, x in enumerate(limits)
    ]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents does not exceed."""
    found = [
        F.min(F.when(F.col("docs_up_to") >= F.ceil(F.lit(float(q)) * F.col("total_docs")), F.col("n_tokens"))).alias(f"q{i}")
        for i, q in enumerate(shares)
    ]
    parts = [F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)]
    return histogram.agg(*found).select(F.explode(F.array(*parts)).alias("x")).select("x.*")
