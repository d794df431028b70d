import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from sessionmill.llm.toxicity import _chunk_features, _chunk_grams, _chunks, packed_grams, toxicity


def corpus(n=900, seed=3):
    draw, docs, labels = random.Random(seed), [], []
    syllables = ["an", "er", "th", "on", "re", "in", "ti", "ou"]
    for i in range(n):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(draw.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(draw.randint(1, 4)):
                words.insert(draw.randrange(len(words)), "zugor" + draw.choice(syllables))
        docs.append((i, " ".join(words)))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus()
    odd = [(2000, None), (2001, ""), (2002, "zugoran " * 3000), (None, "an er"), (3, docs[3][1])]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs + odd], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(i, t, None) for i, t in labels] + [(None, 1, None), (5, None, None)], "doc_id long, toxic int, quality int")
    rows = toxicity(df, marks).collect()
    assert len(rows) == len(docs) + len(odd)
    known, right, held = dict(labels), 0, 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            if r.held_out and r.doc_id in known:
                held += 1
                right += r.predicted == known[r.doc_id]
    assert held > 50 and right / held >= 0.95
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2002].predicted == 1 and by_id[2000].score == by_id[2001].score and by_id[2000].predicted == 0


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(300)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scores = [{r.doc_id: r.score for r in toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()] == [0.0]
    assert toxicity(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_counts_are_exact_however_many_grams(spark):
    from math import log

    import pyarrow as pa

    from sessionmill.llm.toxicity import SCALE, evidence, packed_grams, train

    draw = random.Random(8)
    made = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(90_000)]
    rows = [(" ".join(made[i : i + 500]), int(i % 5000 == 0)) for i in range(0, len(made), 500)]
    top, seen = [{}, {}], [set() for _ in range(7)]
    for text, toxic in rows:
        for w in set(text.split()):
            padded = "^" * 5 + w + "^"
            for i in range(len(w) + 1):
                g = padded[i : i + 6]
                top[toxic][g] = top[toxic].get(g, 0) + 1
                for k in range(1, 7):
                    seen[k].add(g[6 - k :])
    assert len(seen[6]) > 1 << 19
    counts, contexts = [{} for _ in range(6)], [{} for _ in range(6)]
    for k in range(1, 6):
        for g in seen[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
        for g, n in counts[k].items():
            total, kinds = contexts[k].get(g[:-1], (0, 0))
            contexts[k][g[:-1]] = (total + n, kinds + 1)
    of = [{}, {}]
    for c in (0, 1):
        for g, n in top[c].items():
            total, kinds = of[c].get(g[:-1], (0, 0))
            of[c][g[:-1]] = (total + n, kinds + 1)

    def smoothed(n, total, kinds, lower):
        return (max(n - 0.75, 0) + 0.75 * kinds * lower) / total if total else lower

    def gain(w):
        padded, out = "^" * 5 + w + "^", 0.0
        for i in range(len(w) + 1):
            g, p = padded[i : i + 6], 1 / 1024
            for k in range(1, 6):
                p = smoothed(counts[k].get(g[6 - k :], 0), *contexts[k].get(g[6 - k : -1], (0, 0)), p)
            ps = [smoothed(top[c].get(g, 0), *of[c].get(g[:-1], (0, 0)), p) for c in (0, 1)]
            out += log(max(ps[1], 1e-12)) - log(max(ps[0], 1e-12))
        return out

    asked = sorted({*made[:300], *made[5000:5100], "unseen", "x", "qqqqqqqqqq"})
    tables = train(spark.createDataFrame(rows, "text string, toxic int"))
    grams, begin = packed_grams(pa.array(asked))
    each = {r.gram: r.gain / SCALE for r in evidence(spark.createDataFrame([(int(g),) for g in set(grams.tolist())], "gram long"), tables).collect()}
    got = {w: sum(each[g] for g in grams[a:b].tolist()) for w, a, b in zip(asked, begin[:-1], begin[1:], strict=True)}
    assert all(abs(got[w] - gain(w)) < 1e-6 for w in asked)


def test_shuffled_documents_and_a_very_long_one(spark):
    rows = [(i, ("you awful zorkface " if i % 4 == 0 else "a quiet friendly note ") * (1 + i % 5), i % 4 == 0) for i in range(120)]
    rows += [(500, "a quiet friendly note " * 100_000, False)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in rows], "doc_id long, toxic int")
    want = {r.doc_id: round(r.score, 9) for r in toxicity(docs, labels).collect()}
    assert len(want) == 121 and want[500] < 0.5
    # a table that comes out of a shuffle gives the same
    assert {r.doc_id: round(r.score, 9) for r in toxicity(docs.repartition(3, "text"), labels).collect()} == want


def test_grams_of_a_chunk_are_made_a_part_of_its_words_at_a_time():
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("abcdefghij", k=12)) for _ in range(300_000)})
    texts = [" ".join(words[i : i + 3000]) for i in range(0, len(words), 3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    rows = pa.Table.from_batches(list(_chunks([], 64 << 20)(iter([batch])))).append_column("chunk", pa.array([5], pa.int64()))
    tracemalloc.start()
    told = _chunk_grams(rows)
    _chunk_features([])(rows, told.append_column("gain", told["gram"]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
    assert (told["gram"].to_numpy() == np.unique(packed_grams(pa.array(words))[0])).all()
