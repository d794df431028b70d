import hashlib
import re
import time

from pyspark.sql import functions as F

from sessionmill.llm.pii import KINDS, Model, detect, fit, personal_data, redacted

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def passes(kind, value):
    n = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        return 14 <= len(n) <= 19 and sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(n[::-1])) % 10 == 0
    return kind == 0 or 10 <= len(n) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return sorted(found)


TEXTS = [
    "mail a.b@c.d-e.com or x@y, z@w.q.r. _a@b.c_d@e.f!",
    None,
    "",
    "é😀 +1 (988) 555-2485 and +123 then +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "4111 1111 1111 1111, 4111-1111-1111-1112; 4111111111111111 79927398713  4111  1111 1111 1111 11",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 999999999999.1.1.1.1",
    "9" * 30_000,
    "a" * 30_000 + "@" + "b." * 3000 + "c",
    "1 2 " * 8000,
    "+1" * 50,
    "card 4111111111111111 1.1.1.1 tel +49 30 1234567890 x@y.zz",
    "call 030 1234 5678 or (988) 555-2485; name (at) host (dot) com",
]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x"), (0, TEXTS[0], "x")]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[r.doc_id if r.doc_id is not None else 0])
        told = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[1] == k for w in want) for k in range(4)]
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_trees_add_spans_and_redact(spark):
    rows = [(i, f"phone +1 ({200 + i}) 555-{1000 + i} id {i}{'3' * 12 if i % 2 else '12'}; ref 12-34-{i:04d}") for i in range(300)]
    rows += [(1000, "phone (988) 555-24850 x"), (1001, "a@b.cc +1 (988) 555-2485 z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(df)
    assert model.trees and all(0.5 <= t <= 1 for t in model.thresholds)
    out = {r.doc_id: r for r in redacted(detect(df, model)).collect()}
    assert out[1001].text == "[email] [phone] z"
    assert "555" not in out[0].text
    assert detect(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = personal_data(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_a_long_text_full_of_hits(spark):
    """Half a megabyte of addresses takes seconds, found and redacted."""
    text = "write to anna.b@example.org or 10.20.30.40, " * 12_000
    model = Model((), (), (1.1,) * 4)
    began = time.monotonic()
    found = detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model)
    got = found.select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).first()
    assert got.n == 24_000 and tuple(got["last"]) == (len(text) - 13, 1, len(text) - 2)
    short = detect(spark.createDataFrame([(1, text[: 44 * 500])], "doc_id long, text string"), model)
    assert redacted(short).first().text == "write to [email] or [ip], " * 500
    assert time.monotonic() - began < 60


def test_every_decided_candidate_counts_in_the_fit(spark, monkeypatch):
    """More candidates of a label than any sample held: all of them reach the trees, with their number as weight."""
    from sessionmill.llm import pii

    seen = []
    stored = pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, label="step": seen.append(stored(df, label)) or seen[-1])
    rows = [(i, " ".join(f"+1 (988) 555-{n:04d} no 12-34-567 x," for n in range(60))) for i in range(200)]
    assert fit(spark.createDataFrame(rows, "doc_id long, text string"), rounds=2).trees
    of_label = {r.label: r.n for r in seen[-1].groupBy("label").agg(F.sum("n").alias("n")).collect()}
    assert of_label[1] == 12_000 and of_label[0] >= 12_000
