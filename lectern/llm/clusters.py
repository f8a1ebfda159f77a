"""Centroid clustering with exact integer arithmetic and a PCA-rotated filter.

Every vector is stored with its leading rotated coordinates and the norm of what
they leave out.  The projected distance plus the squared difference of those
norms is a lower bound of the whole distance, so only centroids whose bound does
not exceed the exact distance to the most promising one are verified, in
integers.

Input: rows with an id and an array.  Kept are arrays of exactly ``width``
components, none null or non-finite; all other rows get no result.  Vectors with
a null id are clustered like any other but start no centroid unless too few ids
remain; rows that repeat an id are vectors of their own, equal starting hashes
ordered by their components.  Components outside the long range count as its
ends, distances and sums beyond it are reported as its end.  With fewer kept
vectors than clusters each vector starts one; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored

LEADING = 16  # rotated coordinates that are stored
NARROW = 1 << 27  # below it a squared distance of up to 512 components fits in 63 bits
LONGEST = (1 << 63) - 1
SUMS = "cluster int, dim int, value decimal(38,0)"


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, scale: int = 1024) -> DataFrame:
    """(id, v): kept vectors with each component as floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    kept = rows.where((F.size(x) == width) & F.forall(x, fine))
    return kept.select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")
    )


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[tuple[int, ...]]:
    """The kept vectors with the smallest sha256 of ``seed:id``, in the order of the hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters)
    return [tuple(r["v"]) for r in rows.collect()]


def moments(vectors: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """Number of vectors, largest magnitude, covariance; each task sends one row per moment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, most, total, square = 0, 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            v = np.stack(batch["v"].to_numpy()) if len(batch) else np.empty((0, width), np.int64)
            x = v.astype(np.float64)
            n, total, square = n + len(v), total + x.sum(0), square + x.T @ x
            most = max(most, float(np.abs(x).max(initial=0)))
        if n:
            yield pd.DataFrame({"i": np.arange(2 + width + width * width), "x": np.concatenate([[n, most], total, square.ravel()])})

    rows = vectors.select("v").mapInPandas(run, "i int, x double")
    both = rows.groupBy("i").agg(F.sum("x").alias("total"), F.max("x").alias("most")).orderBy("i").collect()
    if not both:
        return 0, 0, np.zeros((width, width))
    x = np.array([r["total"] for r in both])
    n, mean = int(x[0]), x[2 : 2 + width] / x[0]
    return n, int(both[1]["most"]), x[2 + width :].reshape(width, width) / n - np.outer(mean, mean)


def rotated(vectors: DataFrame, axes: np.ndarray, narrow: bool) -> DataFrame:
    """Stored table (id, v, lead, rest): components, leading rotated coordinates, norm of the remainder."""
    kind = "<i4" if narrow else "<i8"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.stack(batch["v"].to_numpy())
            lead, rest = project(v.astype(np.float64), axes)
            yield pd.DataFrame({
                "id": batch["id"].astype("Int64"),
                "v": [r.tobytes() for r in v.astype(kind)],
                "lead": [r.tobytes() for r in lead.astype("<f8")],
                "rest": rest,
            })

    return stored(vectors.mapInPandas(run, "id long, v binary, lead binary, rest double"), "rotated-vectors")


def project(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = x @ axes
    return lead, np.sqrt(np.maximum((x * x).sum(1) - (lead * lead).sum(1), 0.0))


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray):
    """(cluster, distance, verified): nearest centroid, smaller number first among equals.

    ``v`` and ``centroids`` hold int64, or Python integers where squares may not
    fit.  ``verified`` counts the exact distances that were needed.
    """
    c_lead, c_rest = project(centroids.astype(np.float64), axes)
    norm = (lead * lead).sum(1)[:, None] + (rest * rest)[:, None]
    reach = norm + (c_lead * c_lead).sum(1) + c_rest * c_rest
    bound = (lead * lead).sum(1)[:, None] + (c_lead * c_lead).sum(1) - 2 * (lead @ c_lead.T) + (rest[:, None] - c_rest) ** 2
    # The bound is reckoned in floating point: far more than its rounding is given back.
    bound -= 1e-9 * reach + 1e-6
    exact = lambda rows, j: ((v[rows] - centroids[j]) ** 2).sum(1)
    guess = bound.argmin(1)
    best, at = exact(slice(None), guess), guess.copy()
    limit, verified = best.astype(np.float64), len(v)
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= limit * (1 + 1e-9)) & (guess != j))
        d = exact(rows, j)
        verified += len(rows)
        closer = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
        best[rows[closer]], at[rows[closer]] = d[closer], j
    return at, best, verified


def assigned(table: DataFrame, centroids: list[tuple[int, ...]], axes: np.ndarray, narrow: bool, sums: bool) -> DataFrame:
    """Per vector (id, cluster, distance), or with ``sums`` one row per task, cluster and component."""
    kind = "<i4" if narrow else "<i8"
    wide = np.int64 if narrow else object
    c, width, k = np.array(centroids, dtype=wide), len(axes), axes.shape[1]

    def found(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            if not len(batch):
                continue
            v = np.frombuffer(b"".join(batch["v"]), kind).reshape(-1, width).astype(wide)
            lead = np.frombuffer(b"".join(batch["lead"]), "<f8").reshape(-1, k)
            at, distance, _ = nearest(v, lead, batch["rest"].to_numpy(), c, axes)
            yield batch, v, at, distance

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, _, at, distance in found(batches):
            yield pd.DataFrame({
                "id": batch["id"].astype("Int64"),
                "cluster": at.astype(np.int32),
                "distance": [min(int(d), LONGEST) for d in distance],
            })

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [[0] * (width + 1) for _ in centroids]
        for _, v, at, _ in found(batches):
            for j in np.unique(at):
                members = v[at == j]
                total[j] = [a + int(b) for a, b in zip(total[j], [*members.sum(0), len(members)], strict=True)]
        out = [(j, i, Decimal(x)) for j, row in enumerate(total) if row[-1] for i, x in enumerate(row)]
        yield pd.DataFrame(out, columns=["cluster", "dim", "value"])

    if sums:
        return table.mapInPandas(totals, SUMS)
    return table.mapInPandas(rows, "id long, cluster int, distance long")


def moved(table: DataFrame, centroids: list[tuple[int, ...]], axes: np.ndarray, narrow: bool) -> list[tuple[int, ...]]:
    """Each centroid replaced by the floor of the mean of its vectors; without vectors it stays."""
    width = len(axes)
    parts = assigned(table, centroids, axes, narrow, sums=True)
    total = {(r["cluster"], r["dim"]): int(r["x"]) for r in parts.groupBy("cluster", "dim").agg(F.sum("value").alias("x")).collect()}
    out = list(centroids)
    for j in range(len(centroids)):
        if count := total.get((j, width)):
            out[j] = tuple(total[j, i] // count for i in range(width))
    return out


def cluster(
    rows: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding",
    width: int = 64, scale: int = 1024, leading: int = LEADING,
) -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rounds read the stored table and send sums per task and cluster; the driver
    holds the centroids and ``clusters`` x ``width`` totals only.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, width, scale)
    n, most, covariance = moments(vectors, width)
    narrow = most < NARROW and width <= 512
    axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :leading].copy()
    table = rotated(vectors, axes, narrow)
    centroids = first_centroids(vectors, clusters, seed) if n else [(0,) * width]
    for _ in range(rounds if n else 0):
        centroids = moved(table, centroids, axes, narrow)
    result = stored(assigned(table, centroids, axes, narrow, sums=False), "clusters")
    end = F.lit(LONGEST).cast("decimal(38,0)")
    per = {
        r["cluster"]: int(r["d"])
        for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    }
    sums = [
        (j, Decimal(d), Decimal(sum(per.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for j, d in sorted(per.items())
    ]
    facts = spark.createDataFrame(sums, "cluster int, c decimal(38,0), w decimal(38,0), centroid_sha256 string")
    # One row per cluster.
    return result.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        F.least("c", end).cast("long").alias("cluster_inertia"),
        F.least("w", end).cast("long").alias("inertia"),
        "centroid_sha256",
    )


def sql(clusters: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> str:
    """The same over the table ``embeddings`` as one statement: every distance of every round in full."""
    parts = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {width}),
x AS MATERIALIZED (
  SELECT r, unnest(range({width})) AS i, unnest([floor({scale} * c)::BIGINT FOR c IN e]) AS v FROM kept),
first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST) - 1 AS k FROM kept),
c0 AS MATERIALIZED (SELECT k, i, v FROM first JOIN x USING (r) WHERE k < {clusters})"""]
    near = """
a{n} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT x.r, c.k, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{n} c USING (i) GROUP BY ALL)
  GROUP BY r)"""
    move = """
c{m} AS MATERIALIZED (
  SELECT k, i, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN
    (SELECT k, i, (s - ((s % n) + n) % n)::BIGINT // n AS v
     FROM (SELECT k, i, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY ALL)) m USING (k, i))"""
    for n in range(rounds):
        parts += [near.format(n=n), move.format(n=n, m=n + 1)]
    parts += [near.format(n=rounds), f"""
h AS (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY k)"""]
    return f"""WITH {",".join(parts)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, s AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (k)"""
