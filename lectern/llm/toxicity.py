"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows of its hashed features (the word and
its affixes), so unseen forms of a known stem are near it.  Filters of several
widths run over the whole text, each keeps its maximum, and a logistic layer
gives the score.  Decision thresholds are calibrated by language on rows that
training has not seen.

Input: documents with an id and a text (and optionally a language), labels with
an id and 0 or 1.  Null and empty texts are scored as texts without words.  Null
labels and null ids are not learnt from; of repeated labels the larger counts.
Without labels of both kinds the score is the share of toxic labels (0 without
labels).  Extra columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD_TABLE, empty_text

FOLDS = 5
#: The classifier learns from a bounded sample: so many labelled rows of either kind at most, the smallest by a hash of
#: their ids, among texts of at most LONGEST characters.  Thresholds come from all labelled rows of fold 1, whatever their length.
TOXIC, CLEAN, LONGEST = 2000, 5000, 30_000
STEPS = 16  # score bins per unit of log odds; scores lie within +-30
WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 12
LEAST_DOCS = 3  # training documents that a feature must occur in to have a row
FEATURES = 5
CHUNK = 100_000  # words scored at once


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def tokens(text: str) -> list[str]:
    return text.lower().split()


def features(word: str) -> tuple[int, ...]:
    """64-bit hashes of the bare word, its first 3, 4 and 5 bytes and its last 4; 0 where it is too short."""
    bare = (word if word.isalnum() else "".join(filter(str.isalnum, word))).encode()
    n = len(bare)
    if n == 0:
        return (0,) * FEATURES
    code = xxhash.xxh3_64_intdigest
    return (
        code(bare, 1),
        code(bare[:3], 3) if n >= 3 else 0,
        code(bare[:4], 4) if n >= 4 else 0,
        code(bare[:5], 5) if n >= 5 else 0,
        code(bare[-4:], 2) if n >= 5 else 0,
    )


def hashed_features(words: list[str], part: int = 20_000) -> np.ndarray:
    """Features of words 1, 2, ...; word 0 is padding.  Filled in parts, so that few Python numbers exist at once."""
    out = np.zeros((len(words) + 1, FEATURES), np.uint64)
    for at in range(0, len(words), part):
        some = words[at : at + part]
        out[at + 1 : at + 1 + len(some)] = [features(w) for w in some]
    return out


@dataclass
class Model:
    hashes: np.ndarray  # of features with a row, ascending; row 0 stands for all others
    rows: np.ndarray
    kernels: dict[int, np.ndarray]  # width -> (width, SIZE, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    base: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    constant: float | None = None

    def find(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(hashed.shape, np.int64)
        at = np.searchsorted(self.hashes, hashed).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, at + 1, 0)


def pooled(tables: dict, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Maximum of each filter over each text. Texts are parted by words of number 0, whose embedding is nothing."""
    out = []
    n = len(ids)
    for width in WIDTHS:
        table = tables[width]
        total = np.take(table[0], ids, axis=0)
        for o in range(1, width):
            total[: n - o] += np.take(table[o], ids[o:], axis=0)
        out.append(np.maximum.reduceat(total, starts, axis=0))
    return np.concatenate(out, axis=1)


def chain(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts one after another, each followed by padding; where each begins."""
    pad = np.zeros(max(WIDTHS), np.int64)
    starts = np.cumsum([0, *(len(t) + len(pad) for t in texts[:-1])])
    return np.concatenate([x for t in texts for x in (t, pad)]), starts


class Scorer:
    """Scores texts; what filters make of a word is kept per worker for the first WORD_TABLE words, and per chunk for others."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        # Row 0 is padding; one row per kept word; then the words of one chunk.  The tables grow as they fill.
        self.tables = {w: np.zeros((w, 1, FILTERS), np.float32) for w in WIDTHS}

    def _place(self, words: list[str], first: int) -> None:
        m = self.model
        vectors = m.rows[m.find(hashed_features(words)[1:])].sum(axis=1)
        end = first + len(words)
        for w in WIDTHS:
            if end > self.tables[w].shape[1]:
                grown = np.zeros((w, end + end // 2, FILTERS), np.float32)
                grown[:, : self.tables[w].shape[1]] = self.tables[w]
                self.tables[w] = grown
            for o in range(w):
                self.tables[w][o, first:end] = vectors @ m.kernels[w][o]

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant)
        out, part, size = [], [], 0
        for i, text in enumerate(texts):
            words = tokens(text)
            part.append(words)
            size += len(words)
            if size >= CHUNK or i == len(texts) - 1:
                out.append(self._some(part))
                part, size = [], 0
        return np.concatenate(out) if out else np.empty(0)

    def _some(self, texts: list[list[str]]) -> np.ndarray:
        own = set().union(*texts)
        new = list(own.difference(self.known))
        at = self.known
        if new:
            room = WORD_TABLE - len(self.known)
            keep, rest = new[:room], new[room:]
            if keep:
                first = len(self.known) + 1
                self._place(keep, first)
                self.known.update(zip(keep, range(first, first + len(keep)), strict=True))
            if rest:
                self._place(rest, WORD_TABLE + 1)
                at = {w: self.known[w] for w in own.intersection(self.known)}
                at.update(zip(rest, range(WORD_TABLE + 1, WORD_TABLE + 1 + len(rest)), strict=True))
        ids, starts = chain([np.fromiter(map(at.__getitem__, t), np.int64, len(t)) for t in texts])
        m = self.model
        hidden = np.maximum(pooled(self.tables, ids, starts) + m.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ m.weights + m.base, -30, 30).astype(np.float64)))


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, batch: int = 256, seed: int = 7) -> Model:
    """Fit on a bounded sample: rows start from the features' log odds, then all weights learn by Adam."""
    labels = np.asarray(labels, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    empty = np.empty(0, np.uint64)
    if share in (0.0, 1.0):
        return Model(empty, np.zeros((1, SIZE), np.float32), {}, empty, empty, 0.0, constant=share)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number) + 1) for w in tokens(t)), np.int32) for t in texts]
    hashed = hashed_features(list(number))
    number.clear()
    # Documents per feature, by label.
    every, inverse = np.unique(hashed, return_inverse=True)
    inverse = inverse.reshape(hashed.shape).astype(np.int32)
    del hashed
    seen = np.zeros((2, len(every)), np.float32)
    for doc, y in zip(docs, labels, strict=True):
        seen[int(y), np.unique(inverse[doc])] += 1
    keep = (seen.sum(0) >= LEAST_DOCS) & (every != 0)
    hashes = every[keep]
    place = np.zeros(len(every), np.int32)
    place[keep] = np.arange(1, len(hashes) + 1)
    rows_of = place[inverse]  # word -> rows of its features
    del every, inverse, place
    n1, n0 = labels.sum(), (1 - labels).sum()
    odds = np.log((seen[1, keep] + 0.5) / (n1 + 1)) - np.log((seen[0, keep] + 0.5) / (n0 + 1))
    rows = np.zeros((len(hashes) + 1, SIZE), np.float32)
    rows[1:] = rng.normal(0, 0.02, (len(hashes), SIZE))
    rows[1:, 0] += np.clip(odds, -2, 6) / 6
    kernels = {w: rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        kernels[w][:, 0, : FILTERS // 2] += 1 / w
    bias = np.full(FILTERS * len(WIDTHS), -0.5, np.float32)
    weights = np.tile(np.r_[np.full(FILTERS // 2, 0.5), np.zeros(FILTERS - FILTERS // 2)], len(WIDTHS)).astype(np.float32)
    base = np.zeros(1, np.float32)
    parts = {"bias": bias, "weights": weights, "base": base, **{f"k{w}": kernels[w] for w in WIDTHS}}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in parts.items()}
    row_moment = np.zeros(len(rows), np.float32)
    balance = np.where(labels == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            ids, starts = chain([docs[i] for i in some])
            words, ids = np.unique(ids, return_inverse=True)
            vectors = rows[rows_of[words]].sum(axis=1)
            ends = np.r_[starts[1:], len(ids)]
            out, where = [], []
            for w in WIDTHS:
                total = np.take(vectors @ kernels[w][0], ids, axis=0)
                for o in range(1, w):
                    total[: len(ids) - o] += np.take(vectors @ kernels[w][o], ids[o:], axis=0)
                top = np.stack([total[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)])
                out.append(np.take_along_axis(total, top, axis=0))
                where.append(top)
            raw = np.concatenate(out, axis=1) + bias
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ weights + base[0], -30, 30)))
            error = ((p - labels[some]) * balance[some] * len(docs) / len(some)).astype(np.float32)
            down = error[:, None] * weights * (raw > 0)
            grads = {"bias": down.sum(0), "weights": hidden.T @ error + 1e-4 * weights, "base": np.array([error.sum()], np.float32)}
            touched, amounts = [], []
            for k, w in enumerate(WIDTHS):
                g = down[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(kernels[w])
                for o in range(w):
                    at_word = ids[np.minimum(where[k] + o, len(ids) - 1)]
                    grad[o] = np.einsum("dfs,df->sf", vectors[at_word], g)
                    touched.append(words[at_word].ravel())
                    amounts.append((g[:, :, None] * kernels[w][o].T[None]).reshape(-1, SIZE))
                grads[f"k{w}"] = grad
            step += 1
            for name, value in parts.items():
                a, b = moments[name]
                a += 0.1 * (grads[name] - a)
                b += 0.01 * (grads[name] ** 2 - b)
                value -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            where_rows = rows_of[np.concatenate(touched)]
            amount = np.repeat(np.concatenate(amounts), FEATURES, axis=0)
            rows_hit, index = np.unique(where_rows.ravel(), return_inverse=True)
            total = np.zeros((len(rows_hit), SIZE), np.float32)
            np.add.at(total, index, amount)
            row_moment[rows_hit] += (total**2).mean(axis=1)
            rows[rows_hit] -= 0.02 * total / (np.sqrt(row_moment[rows_hit])[:, None] + 1e-4)
            rows[0] = 0
    return Model(hashes, rows, kernels, bias, weights, float(base[0]))


def calibrated(
    scores: np.ndarray, labels: np.ndarray, langs: list, least: int = 25, counts: np.ndarray | None = None
) -> dict[str | None, float]:
    """Threshold of best F1 for each language with enough toxic rows, and for all (key None): the middle of the best interval.

    ``counts``: rows that each entry stands for, one where not given.
    """
    counts = np.ones(len(scores)) if counts is None else counts

    def best(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        s, y, n = s[order], y[order], n[order]
        hits = np.cumsum(y * n)
        f1 = 2 * hits / (np.cumsum(n) + (y * n).sum())
        f1[:-1][s[:-1] == s[1:]] = -1  # equal scores stand or fall together
        i = int(f1.argmax())
        low = s[i + 1] if i + 1 < len(s) else 0.0
        return float((s[i] + low) / 2)

    if not len(labels) or not labels.any():
        return {None: 0.5}
    out: dict[str | None, float] = {None: best(scores, labels, counts)}
    langs = np.array([x or "" for x in langs], object)
    for lang in set(langs) - {""}:
        own = langs == lang
        if (labels * counts)[own].sum() >= least and ((labels == 0) * counts)[own].sum() >= least:
            out[lang] = best(scores[own], labels[own], counts[own])
    return out


def labelled(labels: DataFrame, folds: list[int]) -> DataFrame:
    """(doc_id, y) of the given folds, a row per id."""
    rows = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return rows.where(fold("doc_id").isin(folds)).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, folds: list[int], most: dict[int, int]):
    """At most ``most[y]`` rows of each label y from the given folds, by a hash of their ids, with their texts."""
    rows = labelled(labels, folds).withColumn("draw", F.xxhash64("doc_id", F.lit(3)))
    texts = docs.select("doc_id", empty_text().alias("text"))
    texts = texts.where((F.length("text") <= LONGEST) & fold("doc_id").isin(folds))
    parts = []
    for y, n in most.items():
        drawn = rows.where(F.col("y") == y).orderBy("draw", "doc_id").limit(n)  # a few thousand ids
        parts.append(texts.join(F.broadcast(drawn), "doc_id").select("draw", "text", "y"))
    found = parts[0].unionByName(parts[1]).orderBy("draw", "text").toPandas()
    return found["text"].tolist(), found["y"].to_numpy(np.float32)


def calibration(docs: DataFrame, labels: DataFrame, model: Model, lang_col: str | None) -> dict[str | None, float]:
    """Thresholds from every labelled row of fold 1, summed by language, label and bin: at most 961 rows each for a language and label."""
    lang = (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang")
    texts = docs.select("doc_id", empty_text().alias("text"), lang).where(fold("doc_id") == 1)
    rows = score(texts.join(labelled(labels, [1]), "doc_id"), model, "p")
    # Beyond the ends the odds are those of a score of 0 or 1.
    odds = F.least(F.greatest(F.log(F.col("p") / (F.lit(1.0) - F.col("p"))), F.lit(-30.0)), F.lit(30.0))
    odds = F.when(F.col("p") <= 0, F.lit(-30.0)).when(F.col("p") >= 1, F.lit(30.0)).otherwise(odds)
    bins = rows.groupBy("lang", "y", F.round(odds * STEPS).cast("int").alias("bin")).agg(F.count("*").alias("n")).toPandas()
    scores = 1 / (1 + np.exp(-bins["bin"].to_numpy(np.float64) / STEPS))
    return calibrated(scores, bins["y"].to_numpy(np.float64), bins["lang"].tolist(), counts=bins["n"].to_numpy(np.float64))


def fit(docs: DataFrame, labels: DataFrame, lang_col: str | None = "lang") -> Model:
    """Trains on folds 2 to 4 and calibrates thresholds on fold 1; fold 0 is never read."""
    model = train(*sample(docs, labels, [2, 3, 4], {1: TOXIC, 0: CLEAN}))
    model.thresholds = calibration(docs, labels, model, lang_col)
    return model


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``name`` for every whole text; the model (a few MB, bounded by the sample) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series(scorer.scores(batch.tolist()), dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(run, "double")(empty_text(text_col)))


def threshold_of(model: Model, lang: Column) -> Column:
    """Threshold of a row's language; that of all languages where it has none of its own."""
    common = F.lit(model.thresholds.get(None, 0.5))
    own = [(k, v) for k, v in sorted(model.thresholds.items(), key=str) if k is not None]
    if not own:
        return common
    table = F.create_map(*[F.lit(x) for pair in own for x in pair])
    return F.coalesce(F.try_element_at(table, lang.cast("string")), common)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold (by language), flagged (score >= threshold) of every document."""
    model = fit(docs, labels)
    rows = score(docs.select("doc_id", "text", "lang"), model)
    return rows.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold_of(model, F.col("lang")).alias("threshold"),
        (F.col("score") >= threshold_of(model, F.col("lang"))).alias("flagged"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below their language's threshold, with all their columns."""
    model = fit(docs, labels)
    name = max([*docs.columns, "score"], key=len) + "_"  # no column of the input
    kept = score(docs, model, name).where(F.col(name) < threshold_of(model, F.col("lang")))
    return kept.drop(name)
