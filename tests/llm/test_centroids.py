import hashlib

import numpy as np
import pytest

from sessionmill.llm.centroids import LONGEST, assigned, centroid_clusters, loosening, squared, squared_rows


def brute(rows, k=8, rounds=10, width=64, scale=1024, seed="3"):
    """Lloyd's rounds with Python integers: (vec_id, cluster, distance, inertia of the cluster, inertia) of each kept row."""
    kept = [(i, [max(-LONGEST - 1, min(LONGEST, int(np.floor(np.float64(v) * scale)))) for v in e]) for i, e in rows if e is not None and len(e) == width and all(v is not None and np.isfinite(v) for v in e)]
    c = [x for _, x in sorted((row for row in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        own = [near(x) for _, x in kept]
        c = [[sum(v) // len(v) for v in zip(*m, strict=True)] if (m := [x for (_, x), o in zip(kept, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    out = [(i, near(x), min(far(x, c[near(x)]), LONGEST)) for i, x in kept]
    total = {j: min(sum(d for _, o, d in out if o == j), LONGEST) for j in range(len(c))}
    return sorted(((i, j, d, total[j], min(sum(d for *_, d in out), LONGEST), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


def frame(spark, rows):
    # columns of other names than the ones read, and of names that the result uses
    return spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<double>, cluster int, x int")


def test_equals_integer_rounds_on_all_kinds_of_rows(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 6))
    x = centre[rng.integers(0, 6, 300)] + 0.4 * rng.standard_normal((300, 6))
    x[50:120] = x[50]  # copies
    x[200:240] = np.round(x[200:240])  # ties
    rows = list(enumerate(x.tolist())) + [(7, x[7].tolist()), (None, x[3].tolist()), (400, None), (401, [1.0] * 5), (402, [float("nan")] * 6), (403, [None] * 6), (404, [float("inf")] * 6), (405, [])]
    got = centroid_clusters(frame(spark, rows), k=5, width=6)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k=5, width=6)


def test_huge_components_and_small_tables(spark):
    rows = [(i, [float(v)] * 3) for i, v in enumerate([1e300, -1e300, 1e14, -1e14, 1e12, 0.0, 1e6, 123456.7, 3.0, 2.0])]
    got = centroid_clusters(frame(spark, rows), k=4, width=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k=4, width=3)
    assert centroid_clusters(frame(spark, [])).count() == 0
    alone = centroid_clusters(frame(spark, [(5, [0.5] * 64)])).collect()
    assert [tuple(r)[:5] for r in alone] == [(5, 0, 0, 0, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_loosening_bounds_every_point_of_the_sphere_and_is_less_than_the_drift(seed):
    rng = np.random.default_rng(seed)
    less = 0
    for _ in range(300):
        centre, old = rng.standard_normal((2, 4)) * 10
        new, radius = old + rng.standard_normal(4) * rng.uniform(0, 6), rng.uniform(0, 8)
        way = rng.standard_normal((200, 4))
        points = centre + way / np.linalg.norm(way, axis=1, keepdims=True) * radius * rng.uniform(0, 1, (200, 1)) ** 0.25
        gain = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        bound, drift = loosening(centre, radius, old, new), np.linalg.norm(new - old)
        assert gain.max() <= bound + 1e-12 and bound <= drift
        less += bound < 0.9 * drift
    assert less > 100


def test_bounds_leave_most_vectors_unscanned_and_distances_are_exact():
    rng = np.random.default_rng(1)
    c = rng.integers(-400, 400, (8, 64))
    x = c[rng.integers(0, 8, 2000)] + rng.integers(-60, 60, (2000, 64))
    none = np.zeros(8), np.zeros((8, 8))
    own, upper, lower, scanned = assigned(x, None, c, *none)
    assert scanned == 2000
    moved = c + rng.integers(-3, 3, c.shape)
    drift = np.sqrt(squared_rows(moved, c).astype(float)) * (1 + 1e-9)
    old, new = c.astype(float), moved.astype(float)
    loose = np.array([[loosening(old[i], upper[own == i].max(), old[j], new[j]) for j in range(8)] for i in range(8)])
    after, _, _, scanned = assigned(x, (own, upper, lower), moved, drift, loose)
    assert scanned < 200 and (after == np.argmin(squared(x, moved), axis=1)).all()
    huge = np.array([[2**62, -(2**62)], [3, 4]])
    assert squared(huge, huge[1:]).tolist() == [[(2**62 - 3) ** 2 + (2**62 + 4) ** 2], [0]]
