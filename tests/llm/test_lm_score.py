import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from sessionmill.llm.lm_score import WORDS, _bucket_others, _chunk_buckets, _chunk_grams, _chunk_scores, _chunk_words, _packed, _values, _with_totals, lm_scores


def brute(rows, order, alpha=0.4):
    texts = ["".join(c.lower() if c.isascii() else c for c in (t or "")).split() for _, t in rows]
    every = [Counter(tuple(w[i - n + 1 : i + 1]) for w in texts for i in range(n - 1, len(w))) for n in range(1, order + 1)]
    total, out = sum(map(len, texts)), []
    for (i, _), w in zip(rows, texts, strict=True):
        own = [Counter(tuple(w[j - n + 1 : j + 1]) for j in range(n - 1, len(w))) for n in range(1, order + 1)]
        count = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731

        def score(g):
            if len(g) == 1:
                return (count(g) or alpha) / max(1, total - len(w))  # noqa: B023
            return count(g) / max(1, count(g[:-1])) if count(g) else alpha * score(g[1:])

        logs = [math.log(score(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(len(w))]
        out.append((i, len(w), round(sum(logs) / len(w), 6) if w else None))
    return out


ROWS = [(1, "the cat sat on the mat"), (2, "The cat sat on the dog"), (3, None), (4, ""), (5, "  \n"), (6, "unique words here only"), (7, "cat"), (None, "the cat"), (1, "the cat sat on the mat"), (8, "the " * 3000), (9, "on the mat the cat sat")]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("chunk", [20, 10**6])
def test_scores_equal_brute_force(spark, order, chunk):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in ROWS], "doc_id long, text string, score double")
    got = [tuple(r) for r in lm_scores(df, order=order, chunk_chars=chunk).collect()]
    key = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(got, key=key), sorted(brute(ROWS, order), key=key), strict=True):
        assert a[:2] == b[:2] and (a[2] == b[2] or a[2] == pytest.approx(b[2], abs=2e-6))


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("slices", [1, 3])
def test_slices_make_no_difference(spark, slices):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    key = lambda r: (str(r[0]), r[1])
    got = sorted((tuple(r) for r in lm_scores(df, chunk_chars=30, slices=slices).collect()), key=key)
    for a, b in zip(got, sorted(brute(ROWS, 3), key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-6)


def test_slices_hold_all_occurrences_of_few_ngrams():
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(300)) for i in range(1, 40)]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "chunk": pa.array([7] * len(texts), pa.int64())})
    packed = _packed(rows)
    packed = _with_totals(packed, pa.table({"key": pa.array([], pa.int64()), "total": pa.array([], pa.int64())})).to_batches()[0]
    whole, *parts = [pa.Table.from_batches(_chunk_grams(3, s, i)(iter([packed]))).to_pandas() for s in (1, 8) for i in range(s)]
    whole = whole.set_index("key").n
    assert whole.index.is_unique and max(map(len, parts)) < len(whole) / 2
    for part in parts:
        assert (whole[part.key].to_numpy() == part.n).all()
    assert set(whole.index) == {k for part in parts for k in part.key}


def test_chunks_and_buckets_exchange_few_rows():
    chunks = []
    for number in (3, 4):
        texts = [" ".join(f"w{(i * j) % 97}" for j in range(300)) for i in range(number, 40)]
        chunks += _packed(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "chunk": pa.array([number] * len(texts), pa.int64())})).to_batches()
    grams = _chunk_grams(3, 1, 0)
    held = [list(grams(iter([c]))) for c in chunks]
    asked = [pa.Table.from_batches(_chunk_buckets(grams, 2, 5)(iter([c]))) for c in chunks]
    assert all(t.num_rows <= 2 * 5 < sum(b.num_rows for b in h) for t, h in zip(asked, held, strict=True))
    asked = pa.concat_tables(asked)
    for part in range(2):
        rows = [r for i in range(5) for r in _bucket_others(asked.filter((pc.field("part") == part) & (pc.field("bucket") == i))).to_pylist()]
        counts = [dict(zip(h[part]["key"].to_numpy().view("u8").tolist(), h[part]["n"].to_pylist(), strict=True)) for h in held]
        for chunk, own, other in ((3, *counts), (4, *reversed(counts))):
            got = [n for r in rows if r["chunk"] == chunk for n in _values(r["others"]).tolist()]
            assert got == [other.get(k, 0) for k in sorted(own)] and max(got) > 0


def test_a_chunk_holds_few_bytes_a_word():
    words = (np.random.default_rng(1).pareto(1.1, 600_000) * 20).astype(int) % 30_000
    texts = [" ".join(f"w{x}" for x in of) for of in words.reshape(-1, 300).tolist()]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "chunk": pa.array([7] * len(texts), pa.int64())})
    tracemalloc.start()
    try:
        packed, most = _packed(rows), [tracemalloc.get_traced_memory()[1] / len(words)]
        told = []
        for number in (WORDS, *range(8)):
            grams, of = (_chunk_words, 1) if number == WORDS else (_chunk_grams(3, 8, number), 2)
            asked = pa.Table.from_batches(_chunk_buckets(grams, of, 1)(iter(packed.to_batches())))
            others = [_bucket_others(asked.slice(i, 1)) for i in range(asked.num_rows)]
            told.append(pa.concat_tables(others).append_column("slice", pa.array([number] * len(others), pa.int32())))
        told = pa.concat_tables(told)
        tracemalloc.reset_peak()
        scores = _chunk_scores(3, 0.4, 8)(packed, told)
        most.append(tracemalloc.get_traced_memory()[1] / len(words))
    finally:
        tracemalloc.stop()
    assert scores["n_words"].to_pylist() == [300] * len(texts)
    assert most[0] < 50 and most[1] < 100, most
