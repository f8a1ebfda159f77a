"""Alignment of two tokenizers over a corpus: groups of tokens between common ends, linked pairs and their counts.

A is a byte-level tokenizer and reads a space and the text, B is a sentencepiece
model with byte fallback and adds that space itself.  Equal texts meet by a
shuffle on the full text, so each distinct text is tokenised and aligned once;
its links count as often as it occurs, and the measures go back to all its
documents.

Input: rows with an id and a text.  Texts that are null, empty or whose joined
bytes under A or B differ from space and text have no tokens: numbers of 0 and an
empty ``groups_sha256``.  Ids may be null or repeat; each row gets its own
result.  Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.byte_level import byte_coder, byte_pieces, pieces, spelled
from lectern.llm.common import WordTable, join_hot, stored
from lectern.llm.tokens import PLAIN

BROADCAST_PAIRS = 2_000_000
ALIGNED = "key binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, links array<long>"
LETTER, MARK = r"[A-Za-zÀ-ÖØ-öø-ÿ]", r"[.,;:!?%$#&*()|\[\]]"  # as in PLAIN


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sentence_pieces(model) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, a byte piece its byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """Aligned texts.

    A white-space character after another kind begins a token of both, so both
    have a common end before it: pieces between such places are aligned once per
    worker and joined, and within a piece of letters and marks both parts.
    Whether B's vocabulary allows it is checked, not assumed; a text with a piece
    that does not come out as its own bytes is aligned whole.  A record is (text
    form, links as bytes, n_a, n_b), or None where bytes differ.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = byte_coder(a_path, True), sentencepiece.SentencePieceProcessor(model_file=b_path)
        known = byte_pieces(self.a.tokenizer)
        self.a_bytes, self.b_bytes = [known.get(i, b"") for i in range(max(known) + 1)], sentence_pieces(self.b)
        self.a_len, self.b_len = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.a_form, self.b_form = [str(i) for i in range(len(self.a_len))], [str(i) for i in range(len(self.b_len))]
        self.space = self.b.piece_to_id("▁")
        ordinary = [self.b.id_to_piece(i) for i in range(len(self.b_len)) if not self.b.is_byte(i)]
        self.by_piece = self.a.by_piece and not any(re.search(r"[^▁]▁|\n", p) for p in ordinary)
        # Marks that no piece has after a letter begin a token of both.
        joint = set("".join(re.findall(rf"{LETTER}({MARK})", "\n".join(ordinary))))
        self.apart = self.a.short_cut and (lambda marks: marks and marks[0] not in joint)
        self.later, self.exact = WordTable(self._later), WordTable(self._piece)
        self.cores, self.marks = WordTable(lambda p: self._piece(" " + p)), WordTable(self._marks)

    def align(self, a: list[int], b: list[int]) -> tuple[str, bytes]:
        """(text form, links) of two token sequences over the same bytes.  Every token has a byte at least.

        A link is a pair of tokens that end together, the last ones of a group, as
        A's id and B's id in one number.
        """
        a_len, b_len, a_form, b_form = self.a_len, self.b_len, self.a_form, self.b_form
        forms, links = [], []
        x = y = i0 = j0 = j = 0
        for i, t in enumerate(a):
            x += a_len[t]
            while y < x:
                y += b_len[b[j]]
                j += 1
            if x == y:
                left = a_form[t] if i == i0 else ",".join([a_form[k] for k in a[i0 : i + 1]])
                right = b_form[b[j0]] if j == j0 + 1 else ",".join([b_form[k] for k in b[j0:j]])
                forms.append(f"{left}|{right}")
                links.append(t << 32 | b[j - 1])
                i0, j0 = i + 1, j
        return ";".join(forms), array("q", links).tobytes()

    def _record(self, text: str, a: list[int], b: list[int]):
        raw = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return *self.align(a, b), len(a), len(b)

    def _ids(self, raw: bytes) -> list[int]:
        return np.frombuffer(raw, self.a.type).tolist()

    def _later(self, piece: str):
        if self.apart and (m := PLAIN.fullmatch(piece)) and m[1] and self.apart(m[2]):
            first, second = self.cores[m[1]], self.marks[m[2]]
            if first is not None and second is not None:
                return f"{first[0]};{second[0]}", first[1] + second[1], first[2] + second[2], first[3] + second[3]
        return self._piece(spelled(piece))

    def _marks(self, marks: str):
        """Marks that follow a letter: no token of B has both."""
        first, *rest = self.b.encode("a" + marks)
        return self._record(marks, self._ids(self.a.whole(marks)), rest) if self.b_bytes[first] == b" a" else None

    def _piece(self, text: str):
        if not text:
            return "", b"", 0, 0
        a = self._ids(self.a.piece(text))
        if text[0] == " ":
            return self._record(text, a, self.b.encode(text[1:]) or [self.space])
        first, *b = self.b.encode(text)
        return self._record(text, a, b) if first == self.space else None

    def whole(self, text: str):
        """The same without pieces."""
        return self._record(" " + text, self._ids(self.a.whole(" " + text)), self.b.encode(text))

    def __call__(self, text: str):
        """Record of a text that is not empty."""
        if not self.by_piece:
            return self.whole(text)
        found, plain = pieces(" " + text)
        # The leading space ends an empty first piece of a plain text.
        parts = list(map(self.later.__getitem__, found[1:])) if plain else list(map(self.exact.__getitem__, found))
        if None in parts:
            return self.whole(text)
        forms, links, a, b = zip(*parts, strict=True)
        return ";".join(forms), b"".join(links), sum(a), sum(b)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_path, b_path)


def most_pairs(a_path: str, b_path: str) -> int:
    """How many different pairs two vocabularies can have, whatever the corpus.

    Linked tokens end together in the same bytes, so the shorter one is a suffix
    of the longer one.
    """
    made = aligner(a_path, b_path)
    a, b = Counter(made.a_bytes), Counter(made.b_bytes)
    shorter = sum(b[x[k:]] for x in made.a_bytes for k in range(len(x)))
    return shorter + sum(a[x[k:]] for x in made.b_bytes for k in range(1, len(x)))


def aligned(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Stored table of distinct texts (key, copies, text): their measures, different pairs and how many links each has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = aligner(a_path, b_path)
        for batch in batches:
            rows = []
            for key, copies, text in batch.itertuples(index=False):
                form, links, n_a, n_b = made(text) or ("", b"", 0, 0)
                pairs, times = np.unique(np.frombuffer(links, "<i8"), return_counts=True)
                digest = hashlib.sha256(form.encode()).hexdigest() if form else ""
                rows.append((key, copies, n_a, n_b, len(links) // 8, digest, pairs, times))
            yield pd.DataFrame(rows, columns=["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "links"])

    return stored(texts.select("key", "copies", "text").mapInPandas(run, ALIGNED), "aligned-texts")


def align_corpus(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Copies meet map-side: a task sends one row per distinct text.  Pair counts
    are summed map-side too, and there are no more of them than the vocabularies
    allow (``most_pairs``), which bounds the broadcast.  A text that makes up a
    thousandth of the rows is joined back by broadcast (``join_hot``).
    """
    default = default_paths()
    a_path, b_path = a_path or default[0], b_path or default[1]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    some = rows.where("text is not null and text != ''")
    named = F.unhex(F.sha2("text", 256))
    texts = some.groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", named)
    found = aligned(texts, a_path, b_path)
    links = found.select("key", "copies", F.inline(F.arrays_zip("pairs", "links")))
    pairs = links.groupBy(F.col("pairs").alias("pair")).agg(F.sum(F.col("links") * F.col("copies")).alias("n"))
    pairs = stored(pairs.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "pair-counts")
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))
    pairs = pairs.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    if most_pairs(a_path, b_path) <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    counted = links.join(pairs, links["pairs"] == pairs["pair"]).groupBy("key").agg(
        F.sum("links").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"),
    )
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    measures = found.drop("pairs", "links").join(counted, "key", "left").select("key", "copies", *map(zero, numbers), "groups_sha256")
    measures = stored(measures, "text-measures")
    total = measures.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    joined = join_hot(some.select("id", named.alias("key")), measures, "key", "copies", total)
    bare = rows.where("text is null or text = ''").select("id", *[F.lit(0).cast("long").alias(c) for c in numbers], F.lit("").alias("groups_sha256"))
    return joined.select("id", *numbers, "groups_sha256").unionByName(bare).withColumnRenamed("id", id_col)
