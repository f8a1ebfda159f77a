"""Substring dedup: paragraphs by MinHash bands, exact Jaccard and components; verbatim runs of words anywhere.

A paragraph is a line; a long line is cut at sentence ends that its own content
chooses, so a passage inside two different lines is cut alike.  Paragraphs whose
bands collide are compared on their full shingle sets (five words, 0.8); linked
paragraphs are one passage, of which the first place stays.  Runs of RUN (50)
words or more that occur twice are passages as well, wherever they begin and end
(``runs``), unless all their later places lie in paragraphs that go anyhow.

Input: rows with an id and a text.  Null, empty and blank texts have no
paragraphs.  Paragraphs of fewer than LEAST words are not passages.  Rows with a
null id cannot be named and are left out; rows that repeat an id and a text have
the same places, which count once.  Extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, empty_text, forget, grouped, join_hot, lower_bytes, mixed, shingles, stored, word_hashes, word_places, words_of
from lectern.llm.minhash import all_links, sketches
from lectern.llm.runs import repeated_runs

LEAST = 20  # words of a passage
LONG = 64  # words from which a line is cut
WORDS, PERCENT = 5, 80
BROADCAST_BANDS = 1_000_000  # band values (8 bytes each) that may be sent to every executor
BROADCAST_IDS = 2_000_000

SENTENCE = re.compile(r"[.!?][\"')\]]*(?=\s)")


def tuned(percent: int = PERCENT, recall: float = 0.9995, most: int = 24) -> tuple[int, int]:
    """(bands, rows): the sharpest bands that collide for a pair at the similarity with at least ``recall``.

    Sharpest: fewest chance collisions at half the similarity, with at most
    ``most`` values in all.  One row per band would list every paragraph under
    single shingles, which common phrases make very long lists of.
    """
    t = percent / 100
    miss = lambda s, b, r: (1 - s**r) ** b
    fits = [(b, r) for r in range(2, 5) for b in range(1, most // r + 1) if 1 - miss(t, b, r) >= recall]
    return min(fits, key=lambda x: (1 - miss(t / 2, *x)) * x[0])


BANDS, ROWS = tuned()


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the paragraphs of a text, in characters."""
    out = []
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.count(" ") < LONG:
            out.append((at, end))
        else:
            ends = [m.end() for m in SENTENCE.finditer(line)]
            if line.isascii():
                low = line.lower().encode()
                marks = [xxhash.xxh3_64_intdigest(low[e - 24 if e > 24 else 0 : e]) for e in ends]
            else:
                marks = [xxhash.xxh3_64_intdigest(line[max(0, e - 24) : e].lower().encode("utf-8", "surrogatepass")) for e in ends]
            start = 0
            for i, e in enumerate(ends):
                if (i == 0 or marks[i] < marks[i - 1]) and (i + 1 == len(ends) or marks[i] <= marks[i + 1]):
                    out.append((at + start, at + e))
                    start = e
            out.append((at + start, end))
        at = end + 1
    return out


def band_values(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """BANDS values for each paragraph, from the minima of its shingles under BANDS * ROWS bijections.

    ``hashes``: word hashes of paragraphs one after another, ``lengths``: words of
    each, at least WORDS.
    """
    ends = np.cumsum(lengths)
    # Shingles that run into the next paragraph fall between one's last and the next one's first.
    bounds = np.stack([ends - lengths, ends - WORDS + 1], axis=1).ravel()
    values = np.append(shingles(hashes, WORDS), np.uint64(0))
    out = np.empty((len(lengths), BANDS), np.int64)
    # Shingles are mixed already: a product with an odd number is a bijection whose order depends on all their bits.
    salts = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for band in range(BANDS):
        joined = np.full(len(lengths), np.uint64(band + 1))
        for salt in salts[band * ROWS : (band + 1) * ROWS]:
            least = np.minimum.reduceat(values * salt, bounds)[::2]
            joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = (joined >> np.uint64(1)).astype(np.int64)
    return out


def _passages(text: str, lower: bytes, hashes: np.ndarray, first: np.ndarray, behind: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """number, start, end, fingerprint of the words, and hashes of the words, of each paragraph that can be a passage."""
    found = paragraphs(text)
    a = b = np.array(found, np.int64).reshape(-1, 2)
    if len(lower) > len(text):  # bytes of characters
        raw = np.frombuffer(lower, np.uint8)
        a = b = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[a]
    a, b = a[:, 0], b[:, 1]
    lo, hi = np.searchsorted(first, a), np.searchsorted(behind, b, "right")
    # A sentence may end before a space that is none between words; such a word is cut.
    cut = (lo != np.searchsorted(behind, a, "right")) | (hi != np.searchsorted(first, b))
    raw = np.frombuffer(lower, np.uint8)
    wide = np.r_[0, np.cumsum((first[1:] != behind[:-1] + 1) | (raw[behind[:-1]] != 32))]  # not just one space behind a word
    some = np.flatnonzero(cut | (hi - lo >= LEAST))
    cut, lo, hi = cut[some], lo[some], hi[some]
    wide = wide[hi - 1] > wide[lo - (lo == len(first))]
    spans = first[lo - (lo == len(first))], behind[hi - 1]
    for i, odd, p, q, gaps, x, y in zip(*(c.tolist() for c in (some, cut, lo, hi, wide, *spans)), strict=True):
        s, e = found[i]
        if odd:
            words = words_of(text[s:e])
            if len(words) >= LEAST:
                yield i, s, e, xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1, word_hashes(text[s:e])
            continue
        whole = b" ".join(lower[x:y].split()) if gaps else lower[x:y]
        yield i, s, e, xxhash.xxh3_64_intdigest(whole) >> 1, hashes[p:q]


def _with_words(batch: pd.DataFrame) -> Iterator[tuple]:
    """(other column, text, (text in lower case, places of its words)) of each row."""
    other, texts = (batch[c].tolist() for c in batch.columns)
    for some in grouped(texts):
        lower = [lower_bytes(texts[i]) for i in some]
        for i, own, found in zip(some, lower, word_places(lower), strict=True):
            yield other[i], texts[i], (own, *found)


def places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (doc_id, paragraph, start, n_chars, n_words, fp, bands) of every passage of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "paragraph", "start", "n_chars", "n_words", "fp"]

        def finished(rows, hashes):
            out = pd.DataFrame(rows, columns=names)
            return out.assign(bands=list(band_values(np.concatenate(hashes), out["n_words"].to_numpy())))

        for batch in batches:
            rows, hashes, size = [], [], 0
            for doc, text, found in _with_words(batch):
                for i, a, b, fp, words in _passages(text, *found):
                    hashes.append(words)
                    rows.append((doc, i, a, b - a, len(words), fp))
                    size += len(words)
                    if size > 200_000:
                        yield finished(rows, hashes)
                        rows, hashes, size = [], [], 0
            if rows:
                yield finished(rows, hashes)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text")).where("doc_id is not null")
    schema = "doc_id long, paragraph int, start long, n_chars long, n_words int, fp long, bands array<long>"
    return stored(rows.mapInPandas(run, schema), "passages")


def passage_texts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (id, text) of one place for each fingerprint in ``found`` (fp, doc_id, paragraph)."""
    wanted = stored(found.groupBy("doc_id").agg(F.collect_set("paragraph").alias("wanted")), "wanted")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))
    small = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("doc_id")
    rows = rows.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").join(wanted.hint("merge"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for numbers, text, found in _with_words(batch[["wanted", "text"]]):
                numbers = set(numbers)
                out += [(fp, " ".join(text[a:b].split())) for i, a, b, fp, _ in _passages(text, *found) if i in numbers]
            yield pd.DataFrame(out, columns=["id", "text"])

    texts = rows.mapInPandas(run, "id long, text string")
    texts = stored(texts.groupBy("id").agg(F.min("text").alias("text")), "passage-texts")
    forget(wanted)
    return texts


def repeated_paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every place of every paragraph with more than one place.  Equal paragraphs are
    one class by a 63-bit fingerprint of their words, combined map-side, so the
    lists of a band hold different paragraphs only.
    """
    spark = docs.sparkSession
    found = places(docs, id_col, text_col)
    heads = found.groupBy("fp").agg(
        F.min(F.struct("doc_id", "paragraph")).alias("first"), F.countDistinct("doc_id", "paragraph").alias("copies")
    )
    heads = stored(heads.select("fp", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.paragraph").alias("paragraph")), "classes")
    total = heads.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    banded = found.select(F.explode("bands").alias("v"), "fp")
    shared = banded.groupBy("v").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("v")
    shared = stored(shared, "shared-bands")
    small = shared.count() <= BROADCAST_BANDS
    pairs = stored(banded.join(F.broadcast(shared) if small else shared, "v", "left_semi").distinct(), "band-members")
    wanted = heads.join(pairs.select("fp").distinct(), "fp", "left_semi")
    texts = passage_texts(docs, wanted, id_col, text_col)
    classes = stored(sketches(texts, WORDS, id_col="id").select(F.col("id").alias("rep"), "n", "sketch"), "paragraph-sketches")

    members = pairs.join(classes.select(F.col("rep").alias("fp"), "n"), "fp").select("v", F.col("fp").alias("rep"), "n")
    lists = members.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("l"), F.count("*").alias("members")).where("members > 1")
    lists = stored(lists.select("v", F.col("l.rep").alias("leader"), F.col("l.n").alias("leader_n"), "members"), "band-heads")
    most = lists.agg(F.coalesce(F.sum("members"), F.lit(1))).first()[0]
    lists = stored(join_hot(members, lists, "v", "members", most), "band-lists")
    edges = all_links(lists, classes, lambda _: texts, WORDS, PERCENT)
    joined = stored(components(edges, spark), "passage-components")
    forget(shared, pairs, texts, classes, lists, edges)

    named = heads.join(joined, heads["fp"] == joined["id"], "left").select(
        "fp", "copies", "doc_id", "paragraph", F.coalesce("component", "fp").alias("passage_id")
    )
    named = stored(named, "named-classes")
    whole = named.groupBy("passage_id").agg(
        F.sum("copies").alias("places"), F.min(F.struct("doc_id", "paragraph")).alias("first"), F.count("*").alias("classes")
    ).where("places > 1")
    whole = stored(whole.select("passage_id", "places", "first", "classes"), "whole-passages")
    several = whole.agg(F.coalesce(F.sum("classes"), F.lit(1))).first()[0]
    classes = join_hot(named.select("fp", "copies", "passage_id"), whole, "passage_id", "classes", several)
    classes = stored(classes.select("fp", "copies", "passage_id", "places", "first"), "repeated-classes")
    forget(joined)
    rows = found.select("doc_id", "paragraph", "start", "n_chars", "n_words", "fp")
    return join_hot(rows, classes, "fp", "copies", total).select(
        "doc_id",
        "paragraph",
        "start",
        "n_chars",
        "n_words",
        "passage_id",
        "places",
        F.col("first.doc_id").alias("first_doc_id"),
        (F.struct("doc_id", "paragraph") != F.col("first")).alias("removed"),
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every place of every passage with more than one place.

    Columns: doc_id, paragraph (of the first word), start, n_chars, n_words,
    passage_id, places, first_doc_id, removed (false for the first place only).
    """
    lines = stored(repeated_paragraphs(docs, id_col, text_col), "repeated-paragraphs")
    later, origin = repeated_runs(docs, paragraphs, id_col, text_col)
    gone = lines.where("removed").groupBy("doc_id").agg(F.collect_set("paragraph").alias("gone"))
    inside = F.size(F.filter("gone", lambda p: (p >= F.col("p0")) & (p <= F.col("p1"))))
    rows = later.join(gone, "doc_id", "left").withColumn("open", F.coalesce(inside, F.lit(0)) <= F.col("p1") - F.col("p0")).drop("gone")
    rows = stored(rows, "runs")
    shown = rows.groupBy("passage_id").agg(F.max("open").alias("open"), F.count("*").alias("later")).where("open").drop("open")
    shown = shown.join(origin.select("passage_id", F.col("doc_id").alias("first_doc_id")), "passage_id")
    shown = stored(shown.withColumn("places", F.col("later") + 1), "run-passages")
    total = shown.agg(F.coalesce(F.sum("places"), F.lit(1))).first()[0]
    rows = rows.drop("open").withColumn("removed", F.lit(True)).unionByName(origin.withColumn("removed", F.lit(False)))
    runs = join_hot(rows, shown, "passage_id", "places", total).select(
        "doc_id",
        F.col("p0").alias("paragraph"),
        F.col("sc").cast("long").alias("start"),
        (F.col("ec") - F.col("sc")).cast("long").alias("n_chars"),
        (F.col("e") - F.col("s")).alias("n_words"),
        "passage_id",
        "places",
        "first_doc_id",
        "removed",
    )
    return lines.unionByName(runs)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every text without the paragraphs to be removed; the rest is unchanged."""
    gone = repeated_passages(docs, id_col, text_col).where("removed").distinct()
    spans = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "n_chars"))).alias("spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, gaps):
            out, at = [], 0
            for gap in gaps if gaps is not None else []:
                out.append(text[at : gap["start"]])
                at = max(at, gap["start"] + gap["n_chars"])
            return "".join([*out, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))
    return rows.join(spans, "doc_id", "left").select("doc_id", cut("text", "spans").alias("text"))
