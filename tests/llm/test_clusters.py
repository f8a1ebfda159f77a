"""Centroid clustering against plain Python integers, and its bound against exact distances."""

import hashlib
import math

import numpy as np
import pytest

from lectern.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string, id string"


def expected(rows, k, rounds, width, seed=3, scale=1024):
    kept = []
    for vec_id, e, *_ in rows:
        if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, tuple(math.floor(scale * x) for x in e)))
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    put = lambda: [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = put()
        for j in range(len(centroids)):
            own = [v for (_, v), i in zip(kept, at, strict=True) if i == j]
            if own:
                centroids[j] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    at = put()
    end = (1 << 63) - 1
    d = [min(far(v, centroids[j]), end) for (_, v), j in zip(kept, at, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = [sum(x for x, i in zip(d, at, strict=True) if i == j) for j in range(len(centroids))]
    return sorted(
        ((i, j, x, min(per[j], end), min(sum(d), end), sha[j]) for (i, _), j, x in zip(kept, at, d, strict=True)), key=repr
    )


def run(spark, rows, k, rounds, width):
    got = clusters.cluster(spark.createDataFrame(rows, SCHEMA), k, rounds, width=width, leading=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def rows_of(vectors, start=0):
    return [(start + i, [float(x) for x in v], 1, "c", "v", "i") for i, v in enumerate(vectors)]


def test_equal_to_plain_integers(spark):
    rng = np.random.default_rng(7)
    rows = rows_of(np.concatenate([rng.normal(c, 0.3, (40, 5)) for c in (-1, 0, 2)]))
    rows += [rows[3], (3, [0.0] * 5, 1, "c", "v", "i")] + rows_of([[0.5] * 5] * 60, 500)  # repeated ids and one very common vector
    rows += [
        (900, None, 1, "c", "v", "i"), (901, [], 1, "c", "v", "i"), (902, [1.0] * 4, None, None, None, None),
        (903, [1.0, None, 1.0, 1.0, 1.0], 1, "c", "v", "i"), (904, [1.0, float("nan"), 1.0, 1.0, 1.0], 1, "c", "v", "i"),
        (905, [1.0, float("-inf"), 1.0, 1.0, 1.0], 1, "c", "v", "i"), (None, [-0.0, 1e-9, -1e-9, 0.25, 1.0], 1, "c", "v", "i"),
    ]
    assert run(spark, rows, 8, 10, 5) == expected(rows, 8, 10, 5)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_fewer_vectors_than_clusters(spark, count):
    rows = rows_of(np.arange(count * 4).reshape(count, 4) / 7)
    assert run(spark, rows, 8, 2, 4) == expected(rows, 8, 2, 4)


def test_ties_go_to_the_smaller_number(spark):
    rows = rows_of([[x, 0.0] for x in (-1.0, 1.0, 0.0, 0.0, -1.0, 1.0)])
    assert run(spark, rows, 4, 3, 2) == expected(rows, 4, 3, 2)


def test_large_components(spark):
    rows = rows_of([[1e6, -2e6, 3.0], [1e6 + 0.5, -2e6, 3.0], [-4e5, 1.0, 2e6], [0.0, 0.0, 0.0], [9e9, 1.0, 1.0]])
    assert run(spark, rows, 2, 4, 3) == expected(rows, 2, 4, 3)


def test_few_exact_distances_where_vectors_are_apart():
    """The filter rules out most centroids of clustered vectors, and never the nearest."""
    rng = np.random.default_rng(1)
    c = rng.integers(-900, 900, (8, 64))
    v = c[rng.integers(0, 8, 4000)] + rng.integers(-40, 40, (4000, 64))
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :16].copy()
    lead, rest = clusters.project(v.astype(float), axes)
    at, distance, verified = clusters.nearest(v, lead, rest, c, axes)
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert verified < 1.1 * len(v)
