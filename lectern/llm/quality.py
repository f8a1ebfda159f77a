"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model of shape features gives each document's evidence.  Hosts and
paths have posteriors from their documents' evidence, shrunk toward the level
above by pseudo-counts that the spread among sites determines: a sparse site says
little, a large one much.  A document's own evidence is left out of its site's.

Input: documents with an id, a text, a host and a path column; labels with an id
and quality 0 or 1.  Null and empty texts are texts without words; null hosts and
paths are a site of their own.  Null labels are not learnt from; of repeated
labels the smaller counts.  Without labels of both kinds the evidence is the share
of label 1 (1 without labels).  Extra columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import empty_text, join_hot, stored
from lectern.llm.html_text import STOP_WORDS

#: Labelled rows of either kind that the model is fitted on at most, among texts of at most LONGEST characters.
SAMPLE, LONGEST = 4000, 30_000
SYMBOLS = "%$#&*|!@^~<>{}=_+\\"
LEAST_SHARE = 1e-4  # probabilities are kept this far from 0 and 1


def features(text: str) -> list[float]:
    """Shape of a text: sizes, repetition, symbols, case, function words and lines."""
    words = text.split()
    if not words:
        return [0.0] * 12
    n, chars, lines = len(words), len(text), [x for x in text.split("\n") if x]
    return [
        np.log1p(n),
        chars / n,
        len(set(words)) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        sum(map(text.count, SYMBOLS)) / chars,
        sum(map(text.count, "0123456789")) / chars,
        sum(map(str.isupper, words)) / n,
        sum(map(STOP_WORDS.__contains__, text.lower().split())) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        (text.count(".") + text.count(",")) / n,
        float(text.rstrip()[-1:] in ".!?\"”"),
    ]


def fit(texts: list[str], labels: np.ndarray, steps: int = 30, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a ridge logistic regression by Newton steps; the last weight is the constant."""
    share = float(np.mean(labels)) if len(labels) else 1.0
    if share in (0.0, 1.0):
        return np.zeros(12), np.ones(12), np.r_[np.zeros(12), 9.0 if share else -9.0]
    x = np.array([features(t) for t in texts])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    y, w = np.asarray(labels, float), np.zeros(x.shape[1])
    penalty = ridge * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return mean, scale, w


def evidence(docs: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """``docs`` with a column _p: probability of good quality from the text alone."""
    mean, scale, weights = model

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t) for t in batch]).reshape(len(batch), 12)
            z = ((x - mean) / scale) @ weights[:-1] + weights[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("_p", F.pandas_udf(run, "double")(empty_text(text_col)))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LEAST_SHARE)), F.lit(1 - LEAST_SHARE))
    return F.log(p / (1 - p))


def pseudo_count(sites: DataFrame, n: str, s: str, prior: Column) -> float:
    """Moment estimate of the prior's weight in documents: small where sites differ by more than their sizes explain."""
    rate, size = F.col(s) / F.col(n), F.col(n)
    many = sites.where(size > 1).select(rate.alias("r"), size.alias("n"), prior.alias("m"))
    spread, noise, total = many.agg(
        F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2),
        F.sum(F.col("m") * (1 - F.col("m"))),
        F.sum("n"),
    ).first()
    if not total:
        return 1e6
    binomial = many.agg(F.sum(F.col("n") * F.col("m") * (1 - F.col("m")))).first()[0] / total
    between = max(spread - noise, 0.0) / total
    return float(min(1e6, max(1.0, binomial / between - 1))) if between > 0 else 1e6


def site_levels(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Stored (site, np, sp, nh, sh) per host and path, the global mean, and both pseudo-counts."""
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("np"), F.sum("_p").alias("sp")), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("np").alias("nh"), F.sum("sp").alias("sh"), F.count("*").alias("paths")), "hosts")
    total, good, count = hosts.agg(F.sum("nh"), F.sum("sh"), F.sum("paths")).first()
    mean = float(good / total) if total else 1.0
    k_host = pseudo_count(hosts, "nh", "sh", F.lit(mean))
    both = stored(join_hot(paths, hosts, "host", "paths", count or 1), "sites")
    k_path = pseudo_count(both, "np", "sp", (F.col("sh") + k_host * mean) / (F.col("nh") + k_host))
    return both.select(F.struct("host", "path").alias("site"), "np", "sp", "nh", "sh"), mean, k_host, k_path


def posterior(scored: DataFrame, decide: float = 0.5) -> DataFrame:
    """Scored rows (doc_id, host, path, _p) with host_posterior, path_posterior, score and keep."""
    sites, mean, k_host, k_path = site_levels(scored)
    rows = scored.withColumn("site", F.struct("host", "path"))
    total = sites.agg(F.coalesce(F.sum("np"), F.lit(1))).first()[0]
    rows = join_hot(rows, sites, "site", "np", total)
    own = F.col("_p")
    host = (F.col("sh") - own + k_host * mean) / (F.col("nh") - 1 + k_host)
    path = (F.col("sp") - own + k_path * F.col("host_posterior")) / (F.col("np") - 1 + k_path)
    rows = rows.withColumn("host_posterior", host).withColumn("path_posterior", path)
    score = 1 / (1 + F.exp(-(logit(own) + logit(F.col("path_posterior")) - logit(F.lit(mean)))))
    return rows.select(
        "doc_id", "host", "path", F.col("_p").alias("evidence"), "host_posterior", "path_posterior", score.alias("score"),
        (score >= decide).alias("keep"),
    )


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score, keep of every document.

    Labels whose crc32(doc_id as text) mod 5 is 0 are held out.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.where(fold != 0).groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("draw", F.xxhash64("doc_id", F.lit(4)))
    texts = docs.select("doc_id", empty_text().alias("text")).where((F.length("text") <= LONGEST) & (fold != 0))
    parts = []
    for y in (0, 1):
        drawn = rows.where(F.col("y") == y).orderBy("draw", "doc_id").limit(SAMPLE)  # a few thousand ids
        parts.append(texts.join(F.broadcast(drawn), "doc_id").select("draw", "text", "y"))
    # Classes are drawn alike from all labels, so the larger one is weighed down to its sample.
    found = parts[0].unionByName(parts[1]).orderBy("draw", "text").toPandas()
    model = fit(found["text"].tolist(), found["y"].to_numpy(float))
    sites = docs.select(
        "doc_id",
        "text",
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )
    return posterior(stored(evidence(sites, model).drop("text"), "evidence"))
