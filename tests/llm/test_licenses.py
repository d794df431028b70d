import random
import re
import time

from sessionmill.llm.licenses import BASE, WORD, rules, scan

TEXTS = [
    "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
    "x y MIT License Apache license cc-by cc by gnu GENERAL public-license",
    "SPDX-License-Identifier: MIT",
    "Licensed under CC BY-NC 4.0.",
    None,
    "",
    "nothing here; summit licenses",
    "Permission is hereby granted, free of charge, to any person obtaining a copy ... merchantability",
    "mit license " * 2000,
    "été MIT license été",
    "This work is licensed under the GNU General Public License, version 3.",
]


def base(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(WORD, lower)
    found = [(i, label) for i in range(len(words)) for phrase, label in BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_several_hundred_rules():
    assert len(rules()) >= 200
    for r in rules():
        re.compile(r.pattern)


def test_scan(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, TEXTS[2], "x")]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        assert tuple(by_id[i])[1:6] == base(t), t
        assert set(filter(None, by_id[i].base_labels.split(","))) <= set(by_id[i].labels.split(","))
        assert 0 <= by_id[i].score <= 1
    assert by_id[2].labels == "mit" and by_id[2].score == 1.0 and by_id[2].n_base == 0
    assert by_id[3].labels == "cc-by,cc-by-nc" and len(by_id[3].detections) == 1
    assert by_id[6].labels == "" and by_id[6].score == 0
    assert by_id[7].labels == "mit"
    assert by_id[10].labels == "gpl" and len(by_id[10].detections) == 1
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def sentences():
    """A text for each rule: its pattern with the first way of each choice and without optional parts, and with them."""
    for r in rules():
        pattern = r.pattern.replace("[0-9]{4}", "2024").replace("[0-9]", "4").replace("[123]", "2").replace("[12]", "2").replace("[cs]", "s")
        for optional in ("", r"\1"):
            text = pattern
            while (simpler := re.sub(r"\(\?:([^()]*)\)\?", lambda m: m.group(1).split("|")[0] if optional else "", text)) != text or (simpler := re.sub(r"\(\?:([^()]*)\)(?!\?)", lambda m: m.group(1).split("|")[0], text)) != text:
                text = simpler
            text = " ".join(re.sub(r"(\w| )\?", r"\1" if optional else "", text).split())
            assert re.fullmatch(r.pattern, text), (r.pattern, text)
            yield r, text


def test_a_sentence_of_each_rule_is_detected(spark):
    made = list(sentences())
    # alone, between other words, and with other separators than spaces
    rows = [(i, w) for i, (_, t) in enumerate(made) for w in (t, f"This code, {t.upper()}; see below", t.replace(" ", " -\n"))]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    missing = [made[g.doc_id] for g in got if not any(d.priority <= made[g.doc_id][0].priority for d in g.detections)]
    assert not missing, missing[:5]


def test_names_that_begin_or_end_a_text(spark):
    texts = ["gpl v3 applies", "code is under cddl 1.0", "released under gnu lgpl", "available under the new BSD", "Permission is hereby granted, free of charge, to any person obtaining a copy", "summit committee; miscellaneous"]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["", "cddl", "lgpl", "bsd", "mit", ""]


def brute(text):
    """All rules on all texts, without prefilter and keywords; a detection within one of the same or a better priority goes."""
    norm = " " + " ".join(re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))) + " "
    found = []
    for r in rules():
        for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            found.append((start, -(start + m.group().count(" ") + 1), r.priority, r.label))
    kept, reach = [], {}
    for d in sorted(found):
        if not any(p <= d[2] and e >= -d[1] for p, e in reach.items()):
            kept.append(d)
        reach[d[2]] = max(reach.get(d[2], -1), -d[1])
    return [(s, -e, p, label) for s, e, p, label in kept]


def test_detections_equal_all_rules_without_gates(spark):
    draw = random.Random(6)
    made = [t for _, t in sentences()]
    texts = [*TEXTS[:8], *made[::3]]
    for _ in range(60):
        words = " ".join(draw.choice(made) if draw.random() < 0.4 else draw.choice(["the", "license", "mit", "or later", "version 2", "summit", "copyright 1999", "cc"]) for _ in range(12)).split()
        texts.append(draw.choice([" ", "\n", ", ", "-"]).join(words))
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for g in got:
        assert [(d.start, d.end, d.priority, d.label) for d in g.detections] == brute(texts[g.doc_id]), texts[g.doc_id]


def test_a_long_text_full_of_hits(spark):
    """A megabyte of hits takes seconds, as work is in proportion to them."""
    df = spark.createDataFrame([(1, "mit license " * 80_000)], "doc_id long, text string")
    began = time.monotonic()
    got = scan(df).first()
    assert (got.n_base, got.first_word, got.last_word, got.labels) == (80_000, 0, 159_998, "mit")
    assert time.monotonic() - began < 60
