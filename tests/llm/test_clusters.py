"""Clustering with bounds against plain rounds in Python's integers."""

import hashlib
import math
import random

import pytest

from terrafold.llm import clusters


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for j in set(at):
            own = [v for a, (_, v) in zip(at, kept, strict=True) if a == j]
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = [nearest(v) for _, v in kept]
    d = [far(v, centroids[a]) for a, (_, v) in zip(at, kept, strict=True)]
    fits = lambda x: x if x < 1 << 63 else None
    total = {j: sum(x for x, a in zip(d, at, strict=True) if a == j) for j in set(at)}
    beyond = {a for x, a in zip(d, at, strict=True) if x >= 1 << 63}
    inertia = None if beyond else fits(sum(d))
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((i, a, fits(x), None if a in beyond else fits(total[a]), inertia, digest(a)) for (i, _), a, x in zip(kept, at, d, strict=True)), key=str)


def vectors(n=300, dim=4):
    rng = random.Random(2)
    spots = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(spots)]) for i in range(n)]


CASES = {
    "plain": vectors(),
    "ties": [(i, [float(i % 5), float(i % 3), 0.0, -1.0]) for i in range(200)],
    "copies": [(i // 3, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(99, [1.0, 2.0, 3.0, 4.5])],
    "few": [(5, [0.1, 0.2, 0.3, 0.4]), (6, [-5.0, 0.2, 0.3, 0.4])],
    "odd": [*vectors(60), (None, [0.5] * 4), (None, [0.5] * 4), (7, None), (8, [1.0, 2.0, 3.0]), (9, [1.0, None, 0.0, 0.0]), (10, [math.nan, 1.0, 1.0, 1.0]), (11, [math.inf, 1.0, 1.0, 1.0]), (12, [])],
    "large": [*vectors(60), (1000, [1e30, -1e30, 0.5, 0.5]), (1001, [1e30, -1e30, 0.5, 0.75]), (1002, [3e5, 0.0, 0.0, 0.0])],
    "beyond": [*vectors(40), (1000, [1.7e308, 0.0, 0.0, 0.0]), (1001, [-1.7e308, 0.0, 0.0, 0.0]), (1002, [1e20, 0.0, 0.0, 0.0])],
}


@pytest.mark.parametrize("case", CASES)
def test_rounds(spark, case):
    df = spark.createDataFrame([(*r, 1, 2) for r in CASES[case]], "vec_id long, embedding array<double>, cluster int, n long").repartition(3)
    got = clusters.clustered(df, clusters=5, rounds=4, dim=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(CASES[case], 5, 4, 4)


def test_empty(spark):
    none = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert clusters.clustered(none, dim=4).collect() == []


def test_bounds_settle_most(spark):
    """After a few rounds most vectors are settled by their bounds alone."""
    import numpy as np
    import pyarrow as pa

    rows = vectors(2000)
    x = np.array([[math.floor(1024 * c) for c in v] for _, v in rows], np.int64)
    start = [[*map(int, v)] for v in x[:6]]
    batch = pa.record_batch({"n": np.arange(len(x)), "v": pa.array([v for _, v in rows])})
    scan, asked = clusters.Scan(start, start), []
    plain = clusters.Scan.all
    for _ in range(12):
        cluster, upper, lower = clusters.nearest(scan, batch, x, np.zeros(len(x), bool), {})
        want = plain(scan, x)[0]
        assert (cluster == want).all()
        new = [[int(c) for c in x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum())] if (cluster == j).any() else c for j, c in enumerate(scan.centroids)]
        batch = pa.record_batch({"n": np.arange(len(x)), "v": batch["v"], "cluster": cluster, "upper": upper, "lower": lower})
        scan = clusters.Scan(new, scan.centroids)
        scan.all = lambda rows, s=scan: asked.append(len(rows)) or plain(s, rows)
    assert asked[-1] < 400
