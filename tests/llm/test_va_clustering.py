"""VA-file clustering against plain Lloyd rounds in numpy: unusable vectors, repeats, few vectors, empty tables."""

import hashlib
import math
import random

import numpy as np

from taxon.llm import va_clustering


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    q = np.array([[math.floor(64 * float(np.float32(x))) for x in v] for _, v in kept], dtype=np.int64)
    seed = [hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else None for i, _ in kept]
    order = sorted(range(len(kept)), key=lambda j: (seed[j] is None, seed[j] or "", list(q[j])))[:k]
    c = q[order].copy()

    def nearest():
        d = ((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        chosen, _ = nearest()
        for j in range(len(c)):
            if (chosen == j).any():
                c[j] = np.floor_divide(q[chosen == j].sum(axis=0), (chosen == j).sum())
    chosen, dist = nearest()
    per = {j: int(dist[chosen == j].sum()) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for j in range(len(c))]
    out = [(kept[i][0], int(chosen[i]), int(dist[i]), per[int(chosen[i])], int(dist.sum()), digest[chosen[i]]) for i in range(len(kept))]
    return sorted(out, key=str)


def run(spark, rows, setting=va_clustering.Clustering()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "vec_id", "embedding", "'x' AS q", "'y' AS cells", "'z' AS cluster", "1 AS seed"
    )
    got = va_clustering.cluster(df, setting).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=str)


def vectors(rng, n, dims=64, centres=5):
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [[float(np.float32(m + rng.gauss(0, 0.3))) for m in rng.choice(middle)] for _ in range(n)]


def test_against_numpy_with_odd_rows(spark):
    rng = random.Random(3)
    data = vectors(rng, 300)
    rows = [(i, v) for i, v in enumerate(data)]
    rows += [(1000, None), (1001, data[0][:63]), (1002, data[1][:63] + [None]), (1003, data[2][:63] + [float("nan")]),
             (1004, data[3][:63] + [float("inf")]), (5, data[5]), (None, data[7]), (7, data[7])]
    assert run(spark, rows) == brute(rows)


def test_few_vectors_ties_and_empty(spark):
    rng = random.Random(4)
    data = vectors(rng, 6)
    rows = [(i, data[i % 3]) for i in range(6)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


def test_approximation_spares_exact_distances():
    rng = np.random.default_rng(0)
    middle = rng.normal(0, 1, (16, 64))
    x = np.floor(64 * (middle[rng.integers(0, 16, 5000)] + rng.normal(0, 0.2, (5000, 64)))).astype(np.int64)
    grid = va_clustering.Grid(x.min(axis=0), x.max(axis=0), 4)
    centroids = np.floor(64 * middle).astype(np.int64)
    least, most = grid.tables(centroids)
    chosen, dist, pairs = va_clustering.assign(x, grid.codes(x), centroids, least, most)
    full = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (chosen == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
    assert pairs < 0.25 * x.shape[0] * 16
