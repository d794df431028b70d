import numpy as np

from sessionmill.llm.ann import best_pairs, neighbours, rounds


def brute(ids, x, every, k):
    out = {}
    norm = np.sqrt((x * x).sum(1))
    for i, q in enumerate(ids):
        if q % every == 0:
            s = (x @ x[i]) / (norm * norm[i])
            order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(s[j], 9), ids[j]))[:k]
            out[q] = [ids[j] for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16))
    x = (centres[rng.integers(0, 8, 1500)] + 0.6 * rng.standard_normal((1500, 16))).astype(np.float32).astype(np.float64)
    x[700:1000] = x[700]
    ids = list(range(1500))
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)]
    rows += [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [float("nan")] * 16, 1), (2150, [None] * 16, 1), (None, [1.0] * 16, 1), (2200, [1.0], 1), (2250, [], 1), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in neighbours(df, most_sample=1000, block_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    want = brute(ids, x, 50, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.95
    assert got[750] == [700, 701, 702, 703, 704] and got[700] == [701, 702, 703, 704, 705]


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert neighbours(spark.createDataFrame([], kind)).count() == 0
    assert neighbours(spark.createDataFrame([(0, [1.0, 2.0])], kind)).count() == 0
    got = neighbours(spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 4.0]), (3, [-1.0, -2.0])], kind)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 7), (0, 2, 3)]


def test_parallel_and_huge_vectors(spark):
    """Multiples of a vector tie, whatever rounding does to them, and go by id; sizes whose squares overflow or vanish take part."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base * (i + 1) / 7).tolist()) for i in range(60)] + [(100, (base * 1e200).tolist()), (101, (base * 1e-200).tolist()), (102, (-base).tolist())]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, v) for q, own in ((0, [1, 2, 3, 4, 5]), (50, [0, 1, 2, 3, 4]), (100, [0, 1, 2, 3, 4])) for v in own]
    assert all(r.score == 1.0 for r in got)


def test_recall_without_structure(spark):
    """Vectors with nothing in common need many visits; recall is kept."""
    x = np.random.default_rng(3).standard_normal((3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(list(range(3000)), x, 50, 5)
    assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.9


def test_rounds():
    assert rounds(16, 16, 4) == [16] and rounds(16, 10, 4) == [10]
    for visits in (17, 40, 98, 302, 5000):
        ends = rounds(16, visits, 4)
        assert ends[-1] == visits and ends == sorted(set(ends)) and ends[0] >= 16 and all(b / a < 9 for a, b in zip(ends, ends[1:], strict=False))


def test_least_cosine_drops_only_what_is_farther():
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((6, 8)), rng.standard_normal((200, 8))
    ids = rng.permutation(200)
    q, c, exact = best_pairs(a, b, ids, 6)
    least = np.array([exact[q == i][3] for i in range(6)])
    assert [(i, j) for i, j, _ in zip(*best_pairs(a, b, ids, 6, least), strict=True)] == [(i, j) for i, j, e in zip(q, c, exact, strict=True) if e >= least[i]]
    assert len(best_pairs(a, b, ids, 6, np.full(6, 2.0))[0]) == 0
