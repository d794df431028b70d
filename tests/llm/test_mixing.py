import hashlib
import random

from pyspark.sql import functions as F

from sessionmill.llm.mixing import LEVELS, mix

WEIGHTS = {"domain": {"a": 3, "b": 1, "none": 0}, "lang": {"en": 2, "off": 0}}


def fill(budget, children):
    """Splits by weight; what full children leave is split again among the rest."""
    given, open_, left = {}, dict(children), budget
    while open_:
        level = left / sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap <= level * w]
        if not full:
            given |= {k: int(left * w // sum(x for _, x in open_.values())) for k, (_, w) in open_.items()}
            break
        for k in full:
            given[k] = open_[k][0]
            left -= open_.pop(k)[0]
    return given


def brute(rows, share, epochs, seed):
    size = {}
    for _, domain, lang, source, n in rows:
        size[domain, lang, source] = size.get((domain, lang, source), 0) + n
    cap = lambda prefix: epochs * sum(n for k, n in size.items() if k[: len(prefix)] == prefix)
    budget = {(): int(sum(size.values()) * share)}
    size = {k: n for k, n in size.items() if all(WEIGHTS.get(level, {}).get(x, 1) > 0 for level, x in zip(LEVELS, k, strict=True))}
    for depth, name in enumerate(LEVELS):
        for parent in [k for k in budget if len(k) == depth]:
            names = {k[depth] for k in size if k[:depth] == parent}
            for child, given in fill(budget[parent], {c: (cap((*parent, c)), WEIGHTS.get(name, {}).get(c, 1)) for c in names}).items():
                budget[(*parent, child)] = given
    out = []
    for leaf in size:
        at = 0
        for epoch in range(epochs):
            own = sorted((hashlib.md5(f"{seed}:{epoch}:{i}:{hashlib.md5(('w ' * n).encode()).hexdigest()}".encode()).hexdigest(), i, n) for i, d, la, s, n in rows if (d, la, s) == leaf)
            for _, i, n in own:
                if at < budget[leaf]:
                    out.append((i, *leaf, epoch, at, n, min(n, budget[leaf] - at)))
                at += n
    return sorted(out)


def test_mix_equals_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for i in range(400):
        domain, lang = draw.choice(["a", "a", "b", "b", "none"]), draw.choice(["en", "de", "off"])
        rows.append((i, domain, lang, draw.choice(["s1", "s1", "s1", "s2"]) + domain, draw.randint(1, 30)))
    df = spark.createDataFrame([(i, "w " * n, d, la, s, 7) for i, d, la, s, n in rows], "doc_id long, text string, domain string, lang string, source string, budget int")
    for share, epochs in ((0.3, 1), (0.9, 1), (1.6, 2), (5.0, 2)):
        got = [tuple(r) for r in mix(df, F.col("domain"), WEIGHTS, share, epochs, 3).collect()]
        assert sorted(got) == brute(rows, share, epochs, 3)


def test_leaves_without_weight_are_no_capacity(spark):
    """A domain of which only a tenth can be used leaves the rest of its budget to its sibling."""
    df = spark.createDataFrame([(1, "w " * 100, "a", "en", "s"), (2, "w " * 900, "a", "off", "s"), (3, "w " * 1000, "b", "en", "s")], "doc_id long, text string, domain string, lang string, source string")
    got = mix(df, F.col("domain"), {"lang": {"off": 0}}, 0.5, 1).collect()
    assert {r.doc_id: r.taken for r in got} == {1: 100, 3: 900}


def test_rows_without_ids_spread_and_carried_columns_stay(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("row"))
    got = mix(df, F.lit("d"), {}, 0.5, 1, carry=("row",)).collect()
    assert len({r.row for r in got}) == len(got) == 1500


def test_nulls_repeats_and_empty_tables(spark):
    kind = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame([(1, "a b", None, None), (1, "a b", None, None), (None, "c", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s")], kind)
    got = mix(df, F.lit(None), {}, 1.0, 1).collect()
    assert sorted((r.doc_id or 0, r.domain, r.lang, r.taken) for r in got) == [(0, "(none)", "en", 1), (1, "(none)", "(none)", 2), (1, "(none)", "(none)", 2)]
    assert mix(spark.createDataFrame([], kind), F.lit("d"), {}, 0.5).count() == 0
