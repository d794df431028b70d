import zlib

import numpy as np
import pyarrow as pa
import pytest

from sessionmill.llm.language import ORDER, fitted, languages, presence

SYLLABLES = {"a": ["ka", "to", "mi", "re", "su"], "b": ["schl", "ung", "eit", "aß", "über"], "c": ["ção", "nh", "ões", "que", "lh"]}


def texts(rng, lang, n_words):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n_words))


def grams(text):
    """The set of a text's grams, by the definition."""
    out = set()
    for w in (text or "").split():
        w = w.lower()
        out |= set(w) | {f" {w} "[i : i + n] for n in range(2, ORDER + 1) for i in range(len(w) + 3 - n)}
    return out


def test_kernel_equals_shared_grams_of_sets():
    rng = np.random.default_rng(1)
    held = [texts(rng, k, int(n)) for k in SYLLABLES for n in rng.integers(1, 40, 12)] + ["", "Über ÜBER über", "x", "\U0001f600 ab\U0001f600"]
    langs = [k for k in SYLLABLES for _ in range(12)] + ["a"] * 4
    model = fitted(held, langs, np.arange(len(held)) % 3 == 0, 1e-4)
    marks = [grams(t) for i, t in enumerate(held) if i % 3 == 0]
    asked = [*held, None, "Tomi schlung lhe 12", "zzz"]
    got = np.concatenate([model.kernel(gram, found) for _, gram, found in presence(pa.array(asked, pa.string()))])
    want = np.array([[len(grams(t) & m) / max(1.0, np.sqrt(len(grams(t)) * len(m))) for m in marks] for t in asked])
    assert np.abs(got - want).max() < 1e-6


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(2)
    held = [texts(rng, k, 30) for k in SYLLABLES for _ in range(10)]
    model = fitted(held, [k for k in SYLLABLES for _ in range(10)], np.arange(30) % 2 == 0, 1e-4)
    whole = model.scores(pa.array(held))
    monkeypatch.setattr("sessionmill.llm.language.CELLS", 500)
    assert np.allclose(whole, model.scores(pa.array(held))) and np.allclose(whole[3:4], model.scores(pa.array(held[3:4])))


@pytest.fixture(scope="module")
def predicted(spark):
    rng = np.random.default_rng(3)
    rows = [(i, texts(rng, k, int(rng.integers(3, 60))), k) for i, k in enumerate(["a", "b", "c"] * 100)]
    # held-out rows are mislabelled: nothing may be learned from them
    rows = [(i, t, "b" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows]
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, "12 34 !?", "b"), (1003, "tomi karesu", None), (None, "tomi karesu tomi", "a"), (1004, "schlung eit " * 60_000, "b"), (1005, "中文", None)]
    rows += [(7, rows[7][1], rows[7][2])] * 300
    df = spark.createDataFrame([(i, t, k, 0.5, True) for i, t, k in rows], "doc_id long, text string, lang string, score double, held_out boolean")
    return rows, languages(df, most_rows=120, most_landmarks=30).collect()


def test_held_out_accuracy_and_odd_rows(predicted):
    rows, out = predicted
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i in range(300):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].lang_pred == "abc"[i % 3] and 0.5 < got[i].score <= 1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "a" and got[None].lang_pred == "a" and not got[None].held_out and got[1004].lang_pred == "b" and got[1005].lang_pred in "abc"
    assert len({(r.lang_pred, r.score) for r in out if r.doc_id == 7}) == 1


def test_small_tables(spark):
    kind = "doc_id long, text string, lang string"
    assert languages(spark.createDataFrame([], kind)).count() == 0
    none = languages(spark.createDataFrame([(1, "word", None), (2, None, "a")], kind)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 2
    one = languages(spark.createDataFrame([(i, "word", "a") for i in range(9)], kind)).collect()
    assert {r.lang_pred for r in one} == {"a"}
