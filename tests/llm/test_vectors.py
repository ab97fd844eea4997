"""Centroid clustering against the plain algorithm."""

import hashlib
import math
import random

import numpy as np
import pytest

from tickloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16, rounds=3, dims=64):
    """Exhaustive assignment with Python integers."""
    own = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(own, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in own]
        c = [[sum(col) // len(col) for col in zip(*mine)] if (mine := [v for (_, v), a in zip(own, of) if a == j]) else w for j, w in enumerate(c)]
    last = [near(v) for _, v in own]
    total = sum(d for d, _ in last)
    return [(i, a, d, sum(e for e, b in last if b == a), total, hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), (d, a) in zip(own, last)]


def vectors(n, seed=4, groups=9, dims=64):
    rng = np.random.default_rng(seed)
    heart = rng.normal(0, 0.4, (groups, dims))
    return [(i, [float(x) for x in (heart[rng.integers(groups)] + rng.normal(0, rng.choice([0.02, 0.2]), dims)).astype(np.float32)], 0) for i in range(n)]


def found(df):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted([tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()], key=key), key


@pytest.mark.parametrize("k", [1, 2, 16])
def test_equals_the_exhaustive_search(spark, k, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 37)
    rows = vectors(400)
    rows += [rows[3], rows[3], (7, rows[9][1], 0), (None, rows[5][1], None), (900, None, 1), (901, rows[0][1][:63], 1), (902, [*rows[0][1][:63], None], 1), (903, [*rows[0][1][:63], float("nan")], 1), (904, [*rows[0][1][:63], float("-inf")], 1), (905, [], 1)]
    rows += [(1000 + i, [0.5] * 64, 0) for i in range(120)] + [(2000 + i, [-0.5] * 64, 0) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("v", "a", "cluster", "members", "VEC_ID"):
        from pyspark.sql import functions as F

        df = df.select("*", F.lit("x").alias(name))
    got, key = found(centroids.cluster(df.repartition(5), k))
    assert got == sorted(plain(rows, k), key=key)


def test_few_vectors_ties_and_empty_tables(spark):
    for rows in ([], [(1, None, 0)], [(1, [0.1] * 64, 0)], [(i, [0.25] * 64, 0) for i in range(30)], [(i, [float(i % 4)] * 64, 0) for i in range(20)]):
        got, key = found(centroids.cluster(spark.createDataFrame(rows, SCHEMA)))
        assert got == sorted(plain(rows), key=key)


def test_bounds_spare_most_scans():
    rng = np.random.default_rng(2)
    heart = rng.integers(-400, 400, (40, 32))
    x = (heart[rng.integers(40, size=3000)] + rng.integers(-30, 30, (3000, 32))).astype(np.int64)
    c = x[:40].copy()
    a, b, upper, lower = np.zeros(3000, np.int64), np.ones(3000, np.int64), np.full(3000, np.inf), np.zeros(3000)
    before, scans = None, []
    for _ in range(12):
        scans.append(len(centroids.Search(c, before).assign(x, a, b, upper, lower)))
        exact = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (exact.argmin(1) == a).all()
        others = exact.copy()
        others[np.arange(3000), a] = np.iinfo(np.int64).max
        assert (upper**2 >= exact.min(1) - 1e-6).all() and (lower**2 <= others.min(1) + 1e-6).all()
        before, c = c, np.stack([x[a == j].sum(0) // max((a == j).sum(), 1) if (a == j).any() else c[j] for j in range(40)])
    assert scans[0] == 3000 and scans[-1] < 300


def test_huge_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 0), (random.randrange(5), [0.0] * 64, 0)], SCHEMA)).collect()
