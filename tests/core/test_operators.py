"""Cases with known answers."""

import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionmill.functions import distance, paths, text
from sessionmill.operators import candidates, compress, index, items, ledger, profile, regions, similarity
from sessionmill.plans.adapters import NOW
from sessionmill.sources import files as named
from sessionmill.sources import stores, transcripts

BLOCK = "session_id string, seq int, block_no int, role string, uuid string, ts string, is_sidechain boolean, cwd string, kind string, text string, tool_name string, input_json string, is_error boolean"
ITEM = "kb_path string, item_id string, category string, slug string, title string, summary string, tags array<string>, paths array<string>, status string, universality string, severity string, created string, updated string, archived_at string, archive_reason string, location string, body string"


def block(seq, role, kind, value=None, tool=None, given=None, cwd="/w", error=False, no=0):
    return ("s", seq, no, role, f"uuid-{seq}-long", "", False, cwd, kind, value, tool, given, error)


def item(kb, id_, category, slug, status="active", universality="unverified", tags=("auth", "jwt"), location="active", severity=None, updated="2024-01-01T00:00:00+00:00", where=()):
    return (kb, id_, category, slug, "t", f"about {slug}", list(tags), list(where), status, universality, severity, "2024-01-01T00:00:00+00:00", updated, None, None, location, "## Why\n" + "x" * 60)


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expression.alias("v")).first().v


def test_utf16_lengths_and_cuts(spark):
    c = F.col("t")
    assert one(spark, text.js_len(c), t="a😀b") == 4
    assert one(spark, text.js_left(c, 3), t="a😀b") == "a😀"
    assert one(spark, text.js_left(c, 2), t="a😀b") == "a"
    assert one(spark, text.js_right(c, 2), t="a😀b") == "b"
    assert one(spark, text.head_and_tail(c, 800, 400, 200), t="x" * 900) == "x" * 400 + " ... [truncated 300 chars] ... " + "x" * 200
    assert one(spark, text.head_only(c, 200, " ... [+{} chars]"), t="y" * 250) == "y" * 200 + " ... [+50 chars]"
    assert one(spark, text.js_trim(c), t=" \t x \r\n") == "x"


def test_history(spark):
    c, entry = F.col("t"), F.lit("new")
    assert one(spark, text.with_history(c, entry), t="a\n\n## History\n\n- old") == "a\n\n## History\n\n- new\n- old"
    assert one(spark, text.with_history(c, entry), t="a\n") == "a\n\n## History\n\n- new"
    assert one(spark, text.with_history(c, entry), t=" ") == "## History\n\n- new"
    assert one(spark, text.with_history(c, entry), t="## History") == "## History\n\n- new"


@pytest.mark.parametrize("base,path,absolute,relative", [("/a/b", "c", "/a/b/c", "c"), ("/a/b", "../c", "/a/c", "../c"), ("/a/b", "/a/b", "/a/b", "."), ("/a/b", "./x/../y/", "/a/b/y", "y"), ("/a", "../../..", "/", ".."), ("/a/web", "/a/web-old/x", "/a/web-old/x", "../web-old/x")])
def test_paths(spark, base, path, absolute, relative):
    b, p = F.col("b"), F.col("p")
    assert one(spark, paths.resolved(b, p), b=base, p=path) == absolute
    assert one(spark, paths.relative(b, paths.resolved(b, p)), b=base, p=path) == relative


def test_profile(spark):
    rows = [block(1, "user", "text", "hi", cwd="/a"), block(2, "assistant", "tool_use", None, "Read", '{"file_path":"/p"}', cwd="/b"), block(3, "user", "text", "OK", cwd="/a"), block(4, "user", None, cwd="/b", no=None), block(5, "system", "text", "ignored" * 9)]
    got = profile.session_profile(spark.createDataFrame(rows, BLOCK)).first()
    assert (got.message_count, got.tokens, got.tools_read, got.user_turns, got.cwd, got.n_cwds, got.skip_reason, got.language) == (4, 6, 1, 2, "/a", 2, "few-user-turns", "en")
    for value, want in (("가나다 abc", "ko"), ("123", "mixed"), ("abcd 가", "en")):
        assert profile.session_profile(spark.createDataFrame([block(1, "user", "text", value)], BLOCK)).first().language == want


def compress_in_steps(rows, target):
    """Drops the oldest assistant messages one at a time."""
    cut = lambda t, n: t if len(t) <= n else f"{t[:n]} ... [truncated {len(t) - n} chars]"
    mid = lambda t: t if len(t) <= 800 else f"{t[:400]} ... [truncated {len(t) - 600} chars] ... {t[-200:]}"
    head = lambda r: f"=== {r[3]} {r[4][:8]} @ (no-ts) ==="
    join = lambda ms: "\n".join(ms)
    fits = lambda t: round(len(t) / 3.5) <= target
    shown = [[(r[3], f"{head(r)}\n{f(r[9]) if r[3] == 'assistant' else r[9]}") for r in rows] for f in (lambda t: t, mid, lambda t: cut(t, 200))]
    for k in range(3):
        if fits(join([m for _, m in shown[k]])):
            return k, join([m for _, m in shown[k]])
    kept = shown[2]
    while any(role == "assistant" for role, _ in kept):
        kept.pop(next(i for i, (role, _) in enumerate(kept) if role == "assistant"))
        if fits(join([m for _, m in kept])):
            return 3, join([m for _, m in kept])
    return 4, None


def test_compression_equals_the_stepwise_rule(spark):
    draw, rows, want = random.Random(2), [], {}
    for s in range(60):
        own = [("s%d" % s, *block(i, draw.choice(["user", "assistant", "assistant"]), "text", "w" * draw.choice([3, 50, 300, 1200]))[1:]) for i in range(draw.randint(1, 9))]
        rows += own
        want["s%d" % s] = compress_in_steps(own, 300)
    frame = spark.createDataFrame(rows, BLOCK)
    for chunk in (4096, 2):
        got = {r.session_id: (r["pass"], r.content) for r in compress.compressed(frame, 300, chunk=chunk).collect()}
        assert {k: (v[0], v[1] if v[0] in (1, 2, 3) else None) for k, v in want.items()} == got
    assert len({v[0] for v in want.values()}) >= 4
    full = {r.session_id: r.content for r in compress.compressed(frame, 300, on_fit="full").where("pass = 0").collect()}
    assert full and full == {r.session_id: r.content for r in compress.full(frame).collect() if r.session_id in full}


def test_a_long_session_is_spread(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").cast("int").alias("seq"), F.lit(0).alias("block_no"), F.when(F.col("id") % 1000 == 0, "user").otherwise("assistant").alias("role"), F.lit("u").alias("uuid"), F.lit("").alias("ts"), F.lit(False).alias("is_sidechain"), F.lit("/w").alias("cwd"), F.lit("text").alias("kind"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("input_json"), F.lit(False).alias("is_error"))
    weights = rows.select("session_id", "seq", (F.col("seq") % 7).cast("bigint").alias("w"))
    sums = compress._older(weights, 100)
    assert sums.where("seq = 19999").first().older == sum(i % 7 for i in range(19_999)) and sums.where("seq = 100").first().older == sum(i % 7 for i in range(100))
    spread = sums.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < n * 0.6
    r = compress.compressed(rows, 1000).first()
    assert r["pass"] == 3 and r.estimated_tokens <= 1000 and r.content.count(" user ") == 20 and r.message_count_after == r.content.count(" @ ")


def test_regions_mask_nested_kbs(spark):
    registry = spark.createDataFrame([(f"{d}/.kb", d) for d in ("/r", "/r/apps/web", "/r/apps/api")], "kb_path string, kb_dir string")
    found = regions.owners(spark.createDataFrame([("/r/x",), ("/r/apps/web/a.ts",), ("/r/apps/web-old/a.ts",), ("/q",), ("/r/apps/api",)], "path string"), registry)
    assert {r.path: r.kb_dir for r in found.collect()} == {"/r/x": "/r", "/r/apps/web/a.ts": "/r/apps/web", "/r/apps/web-old/a.ts": "/r", "/q": None, "/r/apps/api": "/r/apps/api"}
    kept = regions.kept_paths(spark.createDataFrame([(1, "/r/.kb", "/r", ["a/../b", "/r/b", "apps/web/x", "/q"]), (2, "/r/.kb", "/r", [])], "item_key int, kb_path string, kb_dir string, paths array<string>"), registry)
    assert {r.item_key: (r.paths_kept, r.paths_dropped) for r in kept.collect()} == {1: (["b"], ["apps/web/x", "/q"]), 2: ([], [])}
    chain = regions.chains(spark.createDataFrame([("/r/apps",)], "cwd string"), registry, spark.createDataFrame([("/r",)], "dir string")).orderBy("position").collect()
    assert [(r.kb_path, r.relative_to_cwd, r.is_root) for r in chain] == [("/r/apps/api/.kb", "api", False), ("/r/apps/web/.kb", "web", False), ("/r/.kb", "..", True)]


def test_candidates(spark):
    good = {"category": "anti-pattern", "title_slug": "a-b", "summary": "s", "body_markdown": "## Why\n" + "x" * 60, "tags": ["a"], "paths": [], "universality": "universal"}
    cases = [(good, None), ({k: v for k, v in good.items() if k != "tags"}, 1), ([1], 1), ("x", 1), ({**good, "category": 3}, 2), ({**good, "title_slug": "A"}, 3), ({**good, "summary": "  "}, 4), ({**good, "summary": "😀" * 60}, None), ({**good, "tags": ["a", 1]}, 5), ({**good, "tags": ["B"]}, 5), ({**good, "paths": "x"}, 6), ({**good, "universality": None}, 7), ({**good, "severity": "bad"}, 8), ({**good, "category": "decision", "severity": "normal"}, 8), ({**good, "severity": None}, None), ({**good, "body_markdown": "## why\n" + "x" * 60}, 9)]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "{"), (98, None)], "i int, item string")
    got = {r.i: r for r in candidates.validated(df).collect()}
    assert {i: got[i].reject_step for i in range(len(cases))} == {i: s for i, (_, s) in enumerate(cases)}
    assert got[0].severity == "normal" and got[99].reject_step == 1 and got[98].reject_step == 1


def test_similarity(spark):
    held = spark.createDataFrame([item("k", "D-001", "decision", "jwt-refresh"), item("k", "D-002", "decision", "other", tags=("x",)), item("k", "D-003", "decision", "gone", status="archived")], ITEM)
    want = spark.createDataFrame([(1, "k", "decision", "jwt-refresh-loop", ["auth", "jwt"], [])], "candidate_id int, kb_path string, category string, title_slug string, tags array<string>, paths array<string>")
    got = similarity.similar(want, held).collect()
    assert [r.item_id for r in got] == ["D-001"]
    assert got[0].reasons == ["tag_overlap_count=2", "slug_distance_normalized=0.313<=0.4"] and got[0].score == pytest.approx(0.4 * 2 / 3 + 0.4 * (1 - 5 / 16))


def test_equal_scores_of_other_parts_go_by_item_id(spark):
    held = spark.createDataFrame([item("k", "A-007", "decision", "a" * 7 + "b" * 17, tags=("p", "q", "r")), item("k", "A-005", "decision", "a" * 3 + "b" * 21, tags=("p", "q"), where=("x",))], ITEM)
    want = spark.createDataFrame([(1, "k", "decision", "a" * 24, ["p", "q", "r"], ["x"])], "candidate_id int, kb_path string, category string, title_slug string, tags array<string>, paths array<string>")
    # 0.4 * 2 / 3 + 0.4 * 3 / 24 + 0.2 and 0.4 + 0.4 * 7 / 24 are both 31 / 60
    assert [r.item_id for r in similarity.similar(want, held).orderBy("rank").collect()] == ["A-005", "A-007"]
    assert [tuple(r) for r in similarity.suggestions(want, held).collect()] == [(1, "merge", "A-005")]


def test_matches_of_one_id_have_one_order(spark):
    rows = [item("k", "D-001", "decision", "a" * 3 + "b" * 21, tags=("p", "q"), where=("x",)), item("k", "D-001", "decision", "a" * 7 + "b" * 17, tags=("p", "q", "r"))]
    want = spark.createDataFrame([(1, "k", "decision", "a" * 24, ["p", "q", "r"], ["x"])], "candidate_id int, kb_path string, category string, title_slug string, tags array<string>, paths array<string>")
    for held in (rows, rows[::-1]):
        got = similarity.similar(want, spark.createDataFrame(held, ITEM).coalesce(1)).orderBy("rank").collect()
        assert [(r.tag_overlap, r.path_overlap) for r in got] == [(3, False), (2, True)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("longest,table_bytes", [(0, 1 << 25), (32, 1 << 25), (33, 1 << 14), (150, 1 << 25), (140, 1 << 12)])
def test_distances_equal_the_table(monkeypatch, longest, table_bytes):
    monkeypatch.setattr(distance, "TABLE_BYTES", table_bytes)
    rng = random.Random(longest)
    one, other = ["".join(rng.choice("ab가😀-"[: rng.choice((2, 5))]) for _ in range(rng.randint(0, longest))) for _ in range(12)], ["".join(rng.choice("abc😀") for _ in range(rng.randint(0, longest))) for _ in range(15)]
    one = sorted(one + other[:3])
    got = {(i, first + k): d for i, first, part in distance.distances([distance.code_points(t) for t in one], [distance.code_points(t) for t in other]) for k, d in enumerate(part.tolist())}
    assert got == {(i, j): edits(a, b) for i, a in enumerate(one) for j, b in enumerate(other)}
    assert not list(distance.distances([distance.code_points("a")], []))


@pytest.mark.parametrize("longest,table_bytes", [(0, 1 << 25), (32, 1 << 25), (33, 1 << 14), (64, 1 << 10), (90, 1 << 25)])
@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_strings_within_a_share_equal_the_table(monkeypatch, longest, table_bytes, share):
    monkeypatch.setattr(distance, "TABLE_BYTES", table_bytes)
    rng = random.Random(longest)
    texts = ["".join(rng.choice("ab가😀-"[: rng.choice((2, 5))]) for _ in range(rng.randint(0, longest))) for _ in range(30)]
    texts = sorted(texts + [t[:-1] + "b" for t in texts[:10]])
    units = [len(t) + sum(c > "\uffff" for c in t) for t in texts]
    some, others = np.arange(0, len(texts), 2), np.arange(3, len(texts))
    got = {(i, j): d for i, j, d in zip(*map(np.ndarray.tolist, distance.Strings([distance.code_points(t) for t in texts], np.array(units)).distances(some, others, share)), strict=True)}
    assert all(d == edits(texts[i], texts[j]) for (i, j), d in got.items())
    near = {(i, j) for i in some.tolist() for j in others.tolist() if edits(texts[i], texts[j]) <= share * max(units[i], units[j])}
    assert near <= got.keys() and near


def test_distances_are_asked_of_few_pairs():
    rng = random.Random(3)
    slugs = sorted("".join(rng.choice("etaoinshrdlu") for _ in range(24)) for _ in range(600))
    every = np.arange(len(slugs))
    one, _, _ = distance.Strings([distance.code_points(t) for t in slugs], np.full(len(slugs), 24)).distances(every, every, 0.4)
    assert len(slugs) <= len(one) < 0.02 * len(slugs) ** 2


def test_few_classes_ask_many():
    rng = random.Random(6)
    slugs = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(20_200)]
    row = {"slug": slugs, "tags": [["and", "for", "the"]] * 20_000 + [["der", "for", "the"]] * 200, "length": [24] * len(slugs), "block": [0] * len(slugs)}
    began = time.monotonic()
    assert [len(x) for x in similarity._near(row, list(range(len(slugs))), "for", "the", 0, 0, 0.4)] == [0] * 4
    assert time.monotonic() - began < 5


@pytest.mark.parametrize("block", [2, 7, 4000])
def test_promotion_pairs_equal_all_pairs(spark, block):
    rng = random.Random(block)
    slug = lambda: rng.choice(["", "jwt", "jwt-refresh-loop", "a" * 70]) + "".join(rng.choice("abé") for _ in range(rng.randint(0, 6)))
    rows = [item(f"k{rng.randint(0, 5)}", f"D-{i:03}", rng.choice(["decision", "learning"]), slug(), tags=rng.choices("pqrstu", k=rng.randint(0, 5)), status=rng.choice(["active"] * 5 + ["archived"])) for i in range(160)]
    got = sorted(tuple(r) for r in similarity.promotion_pairs(spark.createDataFrame(rows, ITEM), block=block).collect())
    held = sorted((r[0], r[1], r[2], r[3], set(r[6])) for r in rows if r[8] == "active" and len(set(r[6])) >= 2)
    want = []
    for a in held:
        for b in held:
            apart = edits(a[3], b[3]) / max(len(a[3]), len(b[3]), 1)
            if a[2] == b[2] and a[0] < b[0] and len(a[4] & b[4]) >= 2 and apart <= 0.4:
                want.append((*a[:2], *b[:2], len(a[4] & b[4]), apart))
    assert got == sorted(want) and len(got) > 20


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_copies_are_dealt_into_parts(spark, part):
    rows = [item(f"k{i % 4}", f"D-{i:03}", "decision", "auth-fix-loop" + "s" * (i % 3 == 0)) for i in range(40)] + [item("k9", "D-900", "decision", "auth-fix-lop")]
    got = sorted((*r[:4], r.shared_tags, round(r.slug_distance, 9)) for r in similarity.promotion_pairs(spark.createDataFrame(rows, ITEM), part=part).collect())
    held = sorted((r[0], r[1], r[3]) for r in rows)
    assert got == [(*a[:2], *b[:2], 2, round(edits(a[2], b[2]) / max(len(a[2]), len(b[2])), 9)) for a in held for b in held if a[0] < b[0]]


def test_popular_tags_cost_one_comparison_a_pair(spark):
    rng = random.Random(5)
    rows = [item(f"k{i}", "D-001", "decision", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)), tags="pqrst") for i in range(6000)]
    held = spark.createDataFrame(rows, ITEM)
    began = time.monotonic()
    assert similarity.promotion_pairs(held).count() == 0
    assert time.monotonic() - began < 30


def test_creates_equal_a_walk_in_order(spark):
    draw, rows, held = random.Random(4), [], []
    for kb in range(12):
        for i in range(draw.randint(0, 10)):
            held.append(item(f"k{kb}", f"D-{i + 1:03d}", "decision", draw.choice(["fix", "auth-fix", "a", "b-c", f"z{i}"]), status=draw.choice(["active", "active", "deprecated"])))
        for i in range(draw.randint(5, 60)):
            slug = draw.choice(["fix", "auth-fix", "c", "b-c", "x-b-c", "a", "new", "q-w-e", f"s{draw.randint(0, 20)}", f"t-s{draw.randint(0, 20)}"])
            rows.append((len(rows), i, f"k{kb}", "decision", slug, draw.randint(0, 1), draw.randint(0, 1)))
    want = {}
    for kb in {r[2] for r in rows}:
        own = [x for x in held if x[0] == kb]
        active, last, names = sum(x[8] == "active" for x in own), max((int(x[1][2:]) for x in own), default=0), [f"D-001-{x[3]}.md" for x in own]
        for r in sorted((r for r in rows if r[2] == kb), key=lambda r: r[1]):
            if active >= 10:
                want[r[0]] = "category_full"
            elif r[5] and not r[6]:
                want[r[0]] = "region_violation"
            elif any(n.endswith(f"-{r[4]}.md") for n in names):
                want[r[0]] = "duplicate_slug"
            else:
                active, last = active + 1, last + 1
                want[r[0]] = f"D-{last:03d}"
                names.append(f"D-{last:03d}-{r[4]}.md")
    requests = spark.createDataFrame(rows, "req_id bigint, req_order int, kb_path string, category string, title_slug string, n_paths int, n_kept int")
    got = {r.req_id: r.code or r.item_id for r in items.created(requests, spark.createDataFrame(held, ITEM)).collect()}
    assert got == want


def test_creates_without_ids_left(spark):
    held = [item("k0", "D-999", "decision", "old", status="deprecated"), item("k1", "D-998", "decision", "old", status="deprecated")]
    rows = [(200 * kb + i, i, f"k{kb}", "decision", "old" if i == 150 else f"s{i}", 0, 0) for kb in (0, 1) for i in range(200)]
    requests = spark.createDataFrame(rows, "req_id bigint, req_order int, kb_path string, category string, title_slug string, n_paths int, n_kept int")
    got = {r.req_id: r.code or r.item_id for r in items.created(requests, spark.createDataFrame(held, ITEM)).collect()}
    assert got == {i: "D-999" if i == 200 else "id_exhausted" for i in range(400)}


def test_creates_with_slugs_of_many_words(spark):
    long = "-".join(f"w{i}" for i in range(300))
    slugs = [long] + ["-".join(f"w{i}" for i in range(k, 300)) for k in range(1, 300)] + ["last"]
    rows = [(i, i, "k", "decision", slug, 0, 0) for i, slug in enumerate(slugs)]
    requests = spark.createDataFrame(rows, "req_id bigint, req_order int, kb_path string, category string, title_slug string, n_paths int, n_kept int")
    got = {r.req_id: r.code or r.item_id for r in items.created(requests, spark.createDataFrame([item("other", "D-001", "decision", "x")], ITEM)).collect()}
    assert got == {i: "D-001" if i == 0 else "D-002" if i == 300 else "duplicate_slug" for i in range(301)}


def test_edits_give_one_row_an_item(spark):
    held = spark.createDataFrame([item("k", "D-001", "decision", "a", status="deprecated"), item("k", "D-002", "decision", "b", status="archived"), item("k", "D-003", "decision", "c", location="archive"), item("k", "A-001", "anti-pattern", "d")], ITEM)
    registry = spark.createDataFrame([("k", "/r")], "kb_path string, kb_dir string")
    kind = "req_id int, req_order int, kb_path string, item_id string, new_body string, new_summary string, new_tags array<string>, new_paths array<string>, new_universality string, new_severity string, history_note string"
    body = lambda name: f"## Why\n{name} " + "x" * 60
    note = "because of that"
    rows = [
        (0, 0, "k", "D-001", body("one"), "first", None, ["a/../b.py", " ", "/q/c.py", "/r/b.py"], None, "critical", note), (1, 1, "k", "D-001", body("two"), None, None, None, None, None, note + "!"),
        (2, 2, "k", "D-002", body("x"), None, None, None, None, None, note), (3, 3, "k", "D-003", body("x"), None, None, None, None, None, note), (4, 4, "k", "D-009", body("x"), None, None, None, None, None, note),
        (5, 5, "k", "D-001", "short", None, None, None, None, None, note), (6, 6, "k", "D-001", None, "s", None, None, None, None, note), (7, 7, "k", "D-001", body("x"), "", None, None, None, None, note), (8, 8, "k", "D-001", body("x"), None, ["Bad tag"], None, None, None, note),
        (9, 9, "k", "D-001", body("x"), None, None, ["/q/d.py", "../e.py"], None, None, note), (10, 10, "k", "D-001", body("x"), None, None, None, "maybe", None, note), (11, 11, "k", "D-001", body("x"), None, None, None, None, "dire", note), (12, 12, "k", "D-001", body("x"), None, None, None, None, None, "brief"),
        (13, 13, "k", "A-001", body("z"), None, ["t"], [], "universal", "critical", note), (14, 14, "k", "D-001", "short", None, None, None, None, None, "brief"),
    ]
    requests = spark.createDataFrame(rows, kind)
    codes = {i: "schema_violation" for i in (5, 6, 7, 8, 10, 11, 14)} | {0: None, 1: None, 2: "target_archived", 3: "target_archived", 4: "target_not_found", 9: "region_violation", 13: None}
    verdicts = {r.req_id: r for r in items.update_verdicts(requests, held, registry).collect()}
    assert {i: r.code for i, r in verdicts.items()} == {**codes, 12: None}
    assert verdicts[0].new_paths == ["b.py"] and verdicts[0].paths_dropped == ["/q/c.py"] and verdicts[9].paths_dropped == ["/q/d.py", "../e.py"]
    assert {r.req_id: r.code for r in items.update_verdicts(requests, held, registry, superseding=True).collect()} == {**codes, 12: "history_note_too_short"}
    sound = requests.where("req_id <> 12")
    after = {r.item_id: r for r in items.updated(held, sound, F.lit(NOW), registry).collect()}
    assert (after["D-001"].body, after["D-001"].summary, after["D-001"].paths, after["D-001"].severity, after["D-001"].status) == (body("two"), "first", ["b.py"], None, "deprecated")
    assert (after["A-001"].tags, after["A-001"].paths, after["A-001"].universality, after["A-001"].severity, after["A-001"].created) == (["t"], [], "universal", "critical", held.first().created)
    assert after["D-002"].updated != NOW and after["D-001"].updated == NOW
    after = items.superseded(held, sound, F.lit(NOW), registry).collect()
    assert len(after) == 4 and {(r.body, r.status) for r in after if r.item_id == "D-001"} == {(body("two") + f"\n\n## History\n\n- {NOW}: superseded — {note}!", "active")}
    reasons = requests.where("req_id < 5").withColumn("reason", F.concat(F.lit("note "), F.col("req_id").cast("string")))
    assert {r.req_id: r.code for r in items.edit_verdicts(reasons, held, archiving=True).collect()} == {0: None, 1: "already_archived", 2: "already_archived", 3: "already_archived", 4: "target_not_found"}
    live = held.withColumn("status", F.when(F.col("item_id") == "D-001", "active").otherwise(F.col("status")))
    after = items.archived(live, reasons, F.lit(NOW))
    assert sorted((r.item_id, r.status, r.archive_reason) for r in after.collect() if r.item_id != "A-001") == [("D-001", "archived", "note 0"), ("D-002", "archived", None), ("D-003", "active", None)]
    assert items.freed_slots(live, after).where("category = 'decision'").first().freed == 1


def test_creates_become_rows(spark):
    held = spark.createDataFrame([item("/r/.kb", "D-004", "decision", "old")], ITEM)
    registry = spark.createDataFrame([("/r/.kb", "/r"), ("/r/web/.kb", "/r/web")], "kb_path string, kb_dir string")
    body = "## Why\n" + "x" * 60
    rows = [(1, 1, "/r/.kb", "decision", "new-one", "s", ["a"], ["x.py", "/q/y.py"], "universal", "critical", body), (2, 2, "/r/.kb", "decision", "sent-on", "s", ["a"], ["web/z.py"], "universal", None, body), (3, 3, "/r/.kb", "decision", "old", "s", ["a"], [], "universal", None, body), (4, 4, "/r/.kb", "decision", "lost", "s", ["a"], ["/q/z.py"], "universal", None, body), (5, 5, "/r/.kb", "decision", "Bad", "s", ["a"], [], "universal", None, body)]
    requests = spark.createDataFrame(rows, "req_id int, req_order int, kb_path string, category string, title_slug string, summary string, tags array<string>, paths array<string>, universality string, severity string, body string")
    verdicts = items.create_verdicts(requests, held, registry)
    got = {r.req_id: (r.kb_path, r.code or r.item_id, r.rerouted_from, r.paths, r.paths_dropped) for r in verdicts.collect()}
    assert got[1] == ("/r/.kb", "D-005", None, ["x.py"], ["/q/y.py"]) and got[2] == ("/r/web/.kb", "D-001", "/r/.kb", ["web/z.py"], [])
    assert [got[i][1] for i in (3, 4, 5)] == ["duplicate_slug", "region_violation", "schema_violation"]
    after = {(r.kb_path, r.item_id): r for r in items.with_created(held, verdicts, F.lit(NOW)).collect()}
    assert len(after) == 3 and after["/r/.kb", "D-005"].title == "New one" and after["/r/.kb", "D-005"].severity is None


def test_touched_paths_are_non_empty_strings(spark):
    rows = [block(i, "assistant", "tool_use", None, "Read", given) for i, given in enumerate(['{"file_path":""}', '{"file_path":5}', '{"file_path":{"a":1}}', '{"file_path":"/p"}', "{}"])]
    assert profile.touched(spark.createDataFrame(rows, BLOCK)).first().paths == ["/p"]


def test_a_last_line_end_is_no_part_of_slugs_and_tags(spark):
    good = {"category": "decision", "title_slug": "a-b", "summary": "s", "body_markdown": "## Why\n" + "x" * 60, "tags": ["a"], "paths": [], "universality": "universal"}
    df = spark.createDataFrame([(1, json.dumps({**good, "title_slug": "a-b\n"})), (2, json.dumps({**good, "tags": ["a\n"]})), (3, json.dumps(good))], "i int, item string")
    assert {r.i: r.reject_step for r in candidates.validated(df).collect()} == {1: 3, 2: 5, 3: None}


def test_ledger(spark):
    kind = "kb_path string, session_id string, transcript_sha256 string, transcript_mtime_ms bigint, status string, skipped_reason string, extracted_count int, kb_actions array<struct<kb:string,actions:array<string>>>, failure_reason string"
    old = spark.createDataFrame([("k", "s", "h", 1, "failed", None, 0, [], "x", "t0", "t0")], kind + ", first_seen_at string, last_seen_at string")
    stamps = spark.createDataFrame([("k", "s", "h", 2, "processed", None, 3, [], None, 1), ("k", "s", "h2", 2, "processed", None, 3, [], None, 1)], kind + ", stamp_order int")
    once = ledger.upserted(old, stamps, F.lit("t1"))
    assert {(r.transcript_sha256, r.first_seen_at, r.last_seen_at, r.status, r.failure_reason) for r in once.collect()} == {("h", "t0", "t1", "processed", None), ("h2", "t1", "t1", "processed", None)}
    assert sorted(map(str, ledger.upserted(once, stamps, F.lit("t1")).collect())) == sorted(map(str, once.collect()))
    marks = spark.createDataFrame([("skipped", None, None, ["a"], [("a", ["x"])]), ("processed", None, None, ["a", "b"], [("a", ["x"])]), ("processed", None, None, ["a"], [("c", ["x"])]), ("failed", None, None, ["a"], []), ("odd", None, None, ["a"], [])], "status string, skipped_reason string, failure_reason string, affected_kbs array<string>, kb_actions array<struct<kb:string,actions:array<string>>>")
    assert [r.v for r in marks.select(ledger.mark_verdict().alias("v")).collect()] == ["skipped_without_reason", None, "action_outside_affected", "failed_without_reason", "schema_violation"]
    spread = ledger.fanned_out(marks.where("size(affected_kbs) = 2")).orderBy("kb_path").collect()
    assert [len(r.kb_actions) for r in spread] == [1, 0]


def test_index_stays_short(spark):
    rows = [item("k", f"{c[2]}-{i:03d}", c[0], f"slug-{i}", severity="critical" if c[2] == "A" else None, updated=f"2024-01-{i:02d}T", where=["a", "b", "c"]) for c in text.CATEGORIES for i in range(1, 11)]
    docs = index.index_documents(spark.createDataFrame([("k", "n"), ("empty", "e")], "kb_path string, name string"), spark.createDataFrame(rows, ITEM), NOW)
    got = {r.kb_path: r for r in docs.collect()}
    assert got["k"].line_count <= 200 and got["k"].line_count == got["k"].content.count("\n")
    assert got["k"].content.count("- **[A-") == 5 and "(`a, b`)" in got["k"].content
    assert "_(none)_" in got["empty"].content and "- Active: 0 items" in got["empty"].content


def test_item_files_round_trip(spark, tmp_path):
    odd = ["a,b", 'q"uo\'te', "# no comment", "true", "12", "-", "line\nfeed\t", "\u00e9 \U0001f600 \x07", ": x", "[", "~"]
    rows = [item("x", "D-001", "decision", "a-b"), item("x", "A-002", "anti-pattern", "quote", severity="critical", where=["p,q", "r"]), item("x", "L-003", "learning", "old", location="archive", status="archived")]
    rows += [(*item("x", f"R-{i:03d}", "reusable", f"odd-{i}", tags=[t, "plain"], where=[t])[:4], t, t, [t, "plain"], [t], "superseded-by-cross:../a b:D-001", "universal", None, "2024", "2025", None, None, "active", f"---\n{t}\n") for i, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, ITEM)
    stored = stores.rendered_items(frame).select(F.concat_ws("/", F.lit("kb"), "file_name").alias("name"), "content")
    assert named.write_named(stored, str(tmp_path)) == len(rows)
    broken = {"L-001-x.md": "no front matter", "L-002-x.md": "---\nid: L-002\n", "L-003-x.md": "---\nid: [\n---\n", "L-004-x.md": "---\n- a\n---\n", "L-005-x.md": "---\n---\nbody", "L-006-x.md": "---\nid: L-006\ntype: learning\ntitle: 12\n---\n"}
    valid = "---\nid: D-009\ntype: decision\ntitle: One # note\nsummary: >-\n  folded\n  text\ntags:\n  - 'a'\n  - b\npaths: []\nstatus: active\nuniversality: universal\ncreated: 2024-01-01\nupdated: 2024-01-02T00:00:00+09:00\n"
    broken |= {"D-009-x.md": valid + "---\n", "L-007-x.md": valid + "severity: [x]\n---\n", "L-008-x.md": valid + "related: [D-001]\n---\n\nbody\n---\n"}
    (tmp_path / "kb" / "learnings").mkdir(exist_ok=True)
    for name, content in broken.items():
        (tmp_path / "kb" / "learnings" / name).write_text(content)
    got = {r.file_name: r for r in stores.read_items(spark.createDataFrame([(str(tmp_path / "kb"),), (str(tmp_path / "none"),)], "kb_path string")).collect()}
    columns = [f.split()[0] for f in ITEM.split(", ")]
    for row in rows:
        want, r = dict(zip(columns, row, strict=True)), got[f"{row[1]}-{row[3]}.md"]
        assert r.parse_error is None and {c: r[c] for c in columns[1:-1]} == {c: want[c] for c in columns[1:-1]}
        assert r.body == want["body"].removesuffix("\n") + "\n"
    errors = {"L-001": "frontmatter", "L-002": "frontmatter", "L-003": "yaml", "L-004": "mapping", "L-005": "mapping", "L-006": "title", "L-007": "severity", "L-008": "directory", "D-009": "directory"}
    assert {n: got[f"{n}-x.md"].parse_error for n in errors} == errors
    assert (got["D-009-x.md"].title, got["D-009-x.md"].summary, got["D-009-x.md"].tags, got["D-009-x.md"].created) == ("One", "folded text", ["a", "b"], "2024-01-01") and got["L-008-x.md"].body == "body\n---\n" and got["L-008-x.md"].related == ["D-001"]


def test_transcript_files(spark, tmp_path):
    line = lambda **x: json.dumps(x)
    base = {"sessionId": "s1", "cwd": "/w", "uuid": "u", "timestamp": "t"}
    root = tmp_path / "in"
    root.mkdir()
    good = [line(type="summary", summary="x"), line(type="user", message={"content": "hi"}, **base), "", line(type="assistant", message={"content": [{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "a"}, {"k": 1}], "is_error": True}, {"type": "tool_use", "name": "Edit", "input": {"z": 1, "a": "2"}}, {"type": "odd"}]}, **base)]
    (root / "one.jsonl").write_text("\n".join(good))
    (root / "one-summary.jsonl").write_text(line(type="summary", summary="x"))
    (root / "bad.jsonl").write_text(line(type="user", message={"content": "hi"}, **{**base, "sessionId": "s2"}) + "\n{oops")
    files = transcripts.list_files(spark, str(root))
    assert {(r.session_stem, r.has_summary_sibling) for r in files.collect()} == {("one", True), ("bad", False)}
    found = transcripts.parsed(named.lines_of(named.opened(files)))
    outcomes = {r.path.rsplit("/", 1)[1]: (r.outcome, r.bad_line) for r in transcripts.parse_outcomes(found).collect()}
    assert outcomes == {"one.jsonl": ("ok", None), "bad.jsonl": ("json_parse_failed", 2)}
    got = {(r.seq, r.block_no): r for r in transcripts.blocks(found).where("path LIKE '%one.jsonl'").collect()}
    assert got[2, 0].text == "hi" and got[4, 0].text == 'a\n{"k":1}' and got[4, 0].is_error and got[4, 1].input_json == '{"z":1,"a":"2"}' and got[4, 2].kind is None


def test_ledger_files(spark, tmp_path):
    row = {"session_id": "s", "transcript_sha256": "h", "first_seen_at": "t", "last_seen_at": "t", "status": "processed", "extracted_count": 1, "kb_actions": [{"kb": "k", "actions": ["create"]}]}
    for name, content in (("a", json.dumps({"schema_version": 1, "last_run": "t", "sessions": [row]})), ("b", json.dumps({"schema_version": 2, "sessions": [{**row, "transcript_mtime_ms": 5}]})), ("c", json.dumps({"schema_version": 9, "sessions": []})), ("d", "{")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "processed.json").write_text(content)
    rows, rejects = stores.read_ledgers(spark, [str(tmp_path / n / "processed.json") for n in "abcd"])
    assert sorted((r.kb_path[-1], r.transcript_mtime_ms) for r in rows.collect()) == [("a", 0), ("b", 5)]
    assert sorted(r.reason for r in rejects.collect()) == ["unknown_version", "unreadable"]
    content = stores.ledger_json(rows, NOW).where("kb_path LIKE '%b'").first().content
    assert json.loads(content)["sessions"][0]["transcript_mtime_ms"] == 5
    stores.write_ledger(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_summaries(spark):
    files = spark.createDataFrame([(f"/{s}.jsonl", s) for s in "abcd"], "path string, session_stem string")
    shapes = spark.createDataFrame([('{"sessions":[{"sessionId":"a","summary":"A1"}]}',), ('[{"id":"x","summary":"X"}]',), ('{"y":{"summary":"Y"}}',)], "content string")
    found = stores.index_summaries(shapes)
    assert {(r.session_stem, r.summary) for r in found.collect()} == {("a", "A1"), ("x", "X"), ("y", "Y")}
    table = lambda *rows: spark.createDataFrame(list(rows), "session_stem string, summary string")
    got = stores.summaries(files, found, table(("a", "A2"), ("b", "B2")), table(("b", "B3"), ("c", "C3"))).collect()
    assert {(r.session_stem, r.summary, r.origin) for r in got} == {("a", "A1", "index"), ("b", "B2", "sibling"), ("c", "C3", "computed"), ("d", None, None)}


def test_creates_are_walked_as_a_stream(spark):
    """A group's rows may come in any number of batches: what was accepted in one counts in the next."""
    import pyarrow as pa

    slugs = ["a-b", "b", *(f"s{i}" for i in range(12))]
    rows = [("/k", "decision", i, i, s, 0, 5) for i, s in enumerate(slugs)] + [("/k", "learning", 50, 50, "b", 0, 998), ("/k", "learning", 51, 51, "c", 0, 998)]
    names = ["kb_path", "category", "req_id", "req_order", "title_slug", "active", "last_id"]

    def walked(size):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        return [tuple(r.values())[2:] for b in items._in_order(iter(batches)) for r in b.to_pylist()]

    assert walked(1) == walked(3) == walked(100)
    codes = [r[1] for r in walked(3)]
    assert codes == [None, "duplicate_slug", *[None] * 9, *["category_full"] * 3, None, "id_exhausted"]
    assert walked(3)[-1] == (51, "id_exhausted", None, None, 50)


def test_one_line_reads_no_more_than_it_needs(spark):
    """A long text's line is that of its start, also where white space lies at the cut; what follows takes no time."""
    texts = [" " * 1000 + "x y\n z", "a\n" * 400, "w" * 59 + " " * 600 + "\n z", "w" * 480 + " \n z", "😀" * 40 + " x" * 300, " " * 500 + "é", "a" + " \n" * 300 + "b", "short \n one", ""]
    want = []
    for t in texts:
        line = re.sub(r"[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*", " ", t).strip()
        units = len(line.encode("utf-16-le")) // 2
        want.append(line if units <= 60 else line.encode("utf-16-le")[:120].decode("utf-16-le") + "…")
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.one_line(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == want
    began = time.monotonic()
    long = spark.range(1).select(text.one_line(F.concat(F.repeat(F.lit("w"), F.lit(100)), F.repeat(F.lit(" "), F.lit(200_000)), F.lit("z"))).alias("l"))
    assert long.first().l == "w" * 60 + "…" and time.monotonic() - began < 8
