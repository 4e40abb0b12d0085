"""Integer k-means against plain Python, and what the screening spares."""

import hashlib
import random

import pytest

pytest.importorskip("sessionloom.llm.queries")

from sessionloom.llm import centroids  # noqa: E402


def plain(rows, k, rounds, dim, scale=64):
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    heads = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in heads]
    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        cs = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(cs)]
    out = [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept]
    fits = lambda x: x if x < 1 << 63 else None
    by = {}
    for _, n, d in out:
        by.setdefault(n, []).append(d)
    whole = lambda ds: fits(sum(ds)) if all(d < 1 << 63 for d in ds) else None
    return sorted(((i, n, fits(d), whole(by[n]), whole([x for _, _, x in out]), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, n, d in out), key=str)


def vectors(seed, n, dim):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 2]), 0.4) for _ in range(dim)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * (dim - 1)), (n + 3, [None] * dim), (n + 4, [float("nan")] * dim), (n + 5, [float("inf")] * dim), (n + 6, [0.0] * dim), (None, [0.5] * dim)]
    return rows + rows[:5] + [(i, rows[9][1]) for i in range(n + 10, n + 40)]


@pytest.mark.parametrize("k,n,dim", [(16, 200, 64), (5, 60, 12), (30, 10, 8)])
def test_clusters(spark, k, n, dim):
    rows = vectors(k, n, dim)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, distance int").repartition(4)
    got = centroids.centroid_clusters(frame, k=k, dim=dim)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, k, 3, dim)


@pytest.mark.parametrize("size", [1e7, 1e30])
def test_large_components(spark, size):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert sorted(map(tuple, centroids.centroid_clusters(frame, k=4, dim=6).collect()), key=str) == plain(rows, 4, 3, 6)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert centroids.centroid_clusters(frame).count() == 0 and centroids.centroid_clusters(frame.limit(0)).count() == 0


def test_screening_spares_most():
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.floor(64 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    screened = centroids.Screened([c.tolist() for c in v[:16]])
    best, distance = screened.assign(v)
    far = ((v[:, None] - v[None, :16]) ** 2).sum(2)
    assert (best == far.argmin(1)).all() and (distance == far.min(1)).all()
    assert (screened.bounds(v) <= far).all()
    assert screened.compared < 0.35 * screened.pairs
