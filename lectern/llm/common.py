"""Stored intermediates, hot-key joins, word tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import checkpoint_dir

WORD_TABLE = 300_000  # most entries of a worker's word table


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder among the shared ones, removed when the driver's file system closes."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage through a written table in the shared folder.

    Any executor can read the table again, so a lost executor costs its running
    tasks only.  The folder is removed when the driver's file system closes, or
    earlier by ``forget``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path is not None:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of rows with one line per group, whatever the largest group.

    Groups with at least ``total / share`` members number at most ``share``, so
    that side is broadcast with a proven bound; every other key has too few rows
    to weigh on a task and is joined by a shuffle.
    """
    hot = groups.where(F.col(size) * share >= total)
    few = groups.where(F.col(size) * share < total)
    marks = hot.select(F.col(key).alias("_hot"))
    rest = rows.join(F.broadcast(marks), rows[key] == marks["_hot"], "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(few.hint("merge"), key))


class WordTable(dict):
    """word -> value.  First come, first kept: frequent words come early, so a full table keeps them."""

    def __init__(self, make: Callable, limit: int = WORD_TABLE, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(self) < self.limit and len(word) <= self.longest:
            self[word] = value
        return value


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def words_of(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


LANES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
LONG_WORD = 64  # bytes


def word_places(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text, with A-Z in lower case: hashes of the words of ``words_of``, the first byte of each and the byte behind it.

    Words are read eight bytes at a time, all words of all texts at once.
    """
    padded = b" ".join([b"", *texts, b" " * 8])
    raw = np.frombuffer(padded, np.uint8)
    inside = ((raw - np.uint8(9)) > 4) & (raw != 32)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, behind = edges[::2], edges[1::2]
    size = behind - first
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    odd = np.uint64(0x9E3779B97F4A7C15)
    out = mixed((lanes[first] & LANES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * odd))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest) and at < LONG_WORD:
        out[rest] = mixed(out[rest] * odd + (lanes[first[rest] + at] & LANES[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for i in rest:
        out[i] = word_hash(padded[first[i] : behind[i]])
    starts = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(first, starts).tolist()
    return [(out[a:b], first[a:b] - s, behind[a:b] - s) for a, b, s in zip(cuts, cuts[1:], starts.tolist(), strict=False)]


def lower_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def word_hashes(text: str) -> np.ndarray:
    return word_places([lower_bytes(text)])[0][0]


def grouped(texts, size: int = 500_000):
    """Lists of neighbouring positions of ``texts`` with about so many characters."""
    some, chars = [], 0
    for i, text in enumerate(texts):
        some.append(i)
        chars += len(text)
        if chars > size:
            yield some
            some, chars = [], 0
    if some:
        yield some


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))  # a new array, changed in place from here on
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """64-bit hashes of all runs of ``words`` words; a shorter text is one run; none without words."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(words, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return out


def components(edges: DataFrame, spark: SparkSession, most: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): smallest reachable id.

    Alternating large-star and small-star steps.  Each step is a minimum per
    vertex, combined map-side, joined back to the edges, so neither a vertex with
    very many edges nor a component is gathered in one task.
    """
    two_way = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    mark = None
    for _ in range(most):
        both = two_way(now)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        # Small star: every edge points from the larger id to the smaller one.
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .where("a > b")
            .distinct()
        )
        after = stored(small, "edges")
        seen = tuple(
            after.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        )
        forget(now)
        now = after
        # A forest of stars is a fixed point; every vertex then has one edge.
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
