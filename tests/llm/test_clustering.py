import hashlib

import numpy as np
import pytest

from tallyframe.llm import clustering
from tallyframe.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, n, rounds, dimensions):
    """Rows (id, cluster, distance) and centroids by plain Python integers."""
    kept = [(i, [int(np.floor(64 * float(np.float32(v)))) for v in x]) for i, x in rows if x is not None and len(x) == dimensions and all(v is not None and np.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(x) for _, x in order[:n]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, xs in groups.items():
            centroids[j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    return sorted(((i, nearest(x)[1], nearest(x)[0]) for i, x in kept), key=str), centroids


def found(spark, rows, n=4, rounds=3, dimensions=5):
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], SCHEMA).repartition(3)
    out, centroids = clustering.cluster(df, n, rounds, dimensions=dimensions, keep=["vec_id", "cluster"])
    assert out.columns == ["vec_id", "cluster", "distance"]
    return sorted(map(tuple, out.collect()), key=str), centroids.tolist()


def points(seed, n, d=5, spread=3.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, spread, (6, d))
    return [(i, [float(v) for v in (middle[i % 6] + rng.normal(0, 1, d)).astype(np.float32)]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = points(1, 500)
    rows += rows[:60] + [(1000 + i, [0.0] * 5) for i in range(300)]  # repeated rows, one value that a third of all hold
    got = found(spark, rows, n=9)
    want = brute(rows, 9, 3, 5)
    assert got == (want[0], want[1])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0] * 4), (4, [1.0] * 6), (5, [1.0, None, 1.0, 1.0, 1.0]), (6, [nan] * 5), (7, [inf] * 5), (None, [0.5] * 5), (8, [-0.01] * 5), (8, [-0.01] * 5), (9, [-3.0] * 5)]
    got, centroids = found(spark, rows)
    assert (got, centroids) == brute(rows, 4, 3, 5) and len(got) == 4
    assert found(spark, rows[:7]) == ([], []) and found(spark, []) == ([], [])
    huge = [(1, [3e38] * 5), (2, [1.0] * 5)]  # its squared distances fit no long
    assert [r[0] for r in found(spark, huge)[0]] == [2]


def test_ties_go_to_the_smaller_number():
    c = np.array([[0, 0], [4, 0], [2, 2], [2, 2]])
    x = np.array([[2, 0], [2, 2], [0, 0]])
    d = np.stack([np.sqrt(((x - q) ** 2).sum(axis=1)) for q in c], axis=1)
    best, distance, _ = clustering.nearest(x, d, c, c)
    assert best.tolist() == [0, 2, 0] and distance.tolist() == [4, 0, 0]


@pytest.mark.parametrize("scale", [1, 1000, 1 << 20])
def test_bounds_lose_nothing_and_save_distances(scale):
    rng = np.random.default_rng(scale)
    middle = rng.integers(-60 * scale, 60 * scale, (16, 8))
    x = middle[rng.integers(0, 16, 4000)] + rng.integers(-9 * scale, 9 * scale + 1, (4000, 8))
    pivots = x[:6]
    to = np.stack([np.sqrt(((x - q) ** 2).sum(axis=1).astype(float)) for q in pivots], axis=1)
    centroids = middle.copy()
    best, distance, measured = clustering.nearest(x, to, centroids, pivots)
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.6 * len(x) * 16


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, centroids = brute(rows, 16, 3, 64)
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = QUERIES["op13_centroid_clusters"](spark, sf)
    got = sorted(map(tuple, out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == sorted(((i, c, d, sums[c], sum(sums.values()), names[c]) for i, c, d in want), key=str)
