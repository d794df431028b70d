import numpy as np
import pytest

from sessionmill.llm.negatives import Asked, Tree, hard_negatives, intervals, n_tiles, packed_runs, tile_cuts, tiles_of


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """All rows against all anchors with Python integers."""
    clip = lambda v: max(-(1 << 50), min(1 << 50, int(np.floor(np.float64(v) * scale))))
    kept = list({(i, y, tuple(clip(v) for v in e)) for i, e, y in rows if i is not None and y is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)})
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    long = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    out = []
    for i, y, x in kept:
        if i % every:
            continue
        scored = sorted((-dot(x, e), j, z) for j, z, e in kept)
        for p, j in [(-s, j) for s, j, z in scored if z == y and j != i][:positives]:
            far = [(-s, k) for s, k, z in scored if z != y and low * p <= -100 * s <= high * p][:negatives]
            out += [(i, j, r, k, long(p), long(n)) for r, (n, k) in enumerate(far, 1)]
    return sorted(out)


def frame(spark, rows):
    # a column of a name that the result has
    return spark.createDataFrame([(i, e, y, 1) for i, e, y in rows], "vec_id long, embedding array<double>, label int, rank int")


@pytest.mark.parametrize("sizes", [{}, {"tile_rows": 20, "most_tiles": 9, "most_sample": 300}])
def test_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((5, 8))
    x = centre[rng.integers(0, 5, 900)] + 0.8 * rng.standard_normal((900, 8))
    x[100:400] = x[100]  # copies of many labels
    x[500:550] = np.round(x[500:550])  # ties
    rows = [(i, v, int(i * 7 % 4)) for i, v in enumerate(x.tolist())]
    rows += [(0, x[0].tolist(), 0), (0, x[5].tolist(), 1), (None, x[2].tolist(), 1), (1000, None, 1), (1100, x[1].tolist(), None), (1200, [float("nan")] * 8, 1), (1300, [None] * 8, 1), (1400, [2.0, 1.0], 1), (1500, [], 1), (1600, [0.0] * 8, 1)]
    got = hard_negatives(frame(spark, rows), **sizes)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_huge_components_and_small_tables(spark):
    rows = [(i * 50, [float(v), 1.0], i % 2) for i, v in enumerate([1e300, 1e13, -1e300, 3e8, 1e9, 2.0, 5e7, 1.5e9])]
    assert sorted(tuple(r) for r in hard_negatives(frame(spark, rows)).collect()) == brute(rows)
    assert hard_negatives(frame(spark, [])).count() == 0
    assert hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert hard_negatives(frame(spark, [(0, [1.0], 1)])).count() == 0
    alone = frame(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.1], 2)])
    assert [tuple(r) for r in hard_negatives(alone).collect()] == [(0, 1, 1, 2, 65536, 32768)]


def test_packing_is_even_and_boxes_bound_products():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (5000, 6))
    dims = list(range(6))
    runs = packed_runs(x, dims, 64, np.arange(len(x)))
    assert sorted(np.concatenate(runs).tolist()) == list(range(5000)) and max(map(len, runs)) == 64 and len(runs) < 1.3 * 5000 / 64
    cuts = tile_cuts(x, dims, 40)
    sizes = np.bincount(tiles_of(x, cuts), minlength=n_tiles(cuts))
    assert 40 <= n_tiles(cuts) <= 80 and sizes.max() < 4 * sizes.mean()
    assert (tiles_of(np.repeat(x[:1], 9, axis=0), cuts) == tiles_of(x[:1], cuts)[0]).all()
    q, boxes = rng.integers(-50, 50, (7, 6)), [x[run] for run in runs]
    under, over = intervals(q, np.array([b.min(axis=0) for b in boxes]), np.array([b.max(axis=0) for b in boxes]))
    for j, b in enumerate(boxes):
        s = q @ b.T
        assert (s.min(axis=1) >= under[:, j]).all() and (s.max(axis=1) <= over[:, j]).all()


def test_queue_leaves_out_most_leaves_of_clustered_rows():
    rng = np.random.default_rng(5)
    centre = rng.integers(-400, 400, (64, 8))
    x = np.repeat(centre, 64, axis=0) + rng.integers(-5, 5, (4096, 8))
    tree, q = Tree(x, 64, 8), centre[3]
    bounds = tuple(b[0] for b in intervals(q[None], tree.low, tree.high))
    asked, ids = Asked(tree, q), [[i] for i in range(len(x))]
    best = asked.best(bounds, np.ones(len(x), bool), ids, 10, (-np.inf, np.inf), -np.inf)
    scores = sorted((-int(s), i) for i, s in enumerate(x @ q))
    assert best == scores[:10] and asked.visited.sum() < 64 / 3
    # another window of the same question, and rows that do not fit
    top, odd = -best[0][0], tree.order % 2 == 1
    assert asked.best(bounds, odd, ids, 10, (0.3 * top, 0.9 * top), -np.inf) == [(s, i) for s, i in scores if i % 2 and 0.3 * top <= -s <= 0.9 * top][:10]
