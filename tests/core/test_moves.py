"""Promotions and demotions against a walk through the requests in their order."""

import random

import pytest
from pyspark.sql import functions as F

from sessionmill.operators import moves
from sessionmill.plans.adapters import NOW

ITEM = "kb_path string, item_id string, category string, slug string, title string, summary string, tags array<string>, paths array<string>, status string, universality string, severity string, created string, updated string, archived_at string, archive_reason string, location string, body string"
NEW = "category string, title_slug string, summary string, body string, tags array<string>, paths array<string>, severity string"
PROMOTE = f"req_id int, req_order int, target_kb string, origins array<struct<kb_path:string,item_id:string>>, {NEW}"
DEMOTE = f"req_id int, req_order int, origin_kb string, origin_id string, target_kb string, {NEW}"
BODY = "## Why\n" + "x" * 60


def item(kb, id_, status="active", universality="unverified", location="active"):
    category = {"D": "decision", "L": "learning"}[id_[0]]
    return (kb, id_, category, "slug", "t", "about", ["auth"], [], status, universality, None, "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00", None, None, location, BODY)


def new(category="decision", slug="new-one", body=BODY, paths=(), severity=None):
    return (category, slug, "about", body, ["auth"], list(paths), severity)


def tables(spark, dirs, stops=()):
    registry = spark.createDataFrame([(f"{d}/.kb", d) for d in dirs], "kb_path string, kb_dir string")
    return registry, spark.createDataFrame([(d,) for d in stops], "dir string")


def chain(kb, dirs):
    here, out = kb.removesuffix("/.kb"), []
    while here:
        if here in dirs:
            out.append(f"{here}/.kb")
        here = here.rsplit("/", 1)[0]
    return out


def walk(requests, held, dirs, demoting=False):
    """One request after the other, as a single writer would take them: code or new id of each."""
    state, out = {(i[0], i[1]): [i[8], i[9], i[15]] for i in held}, {}
    active = lambda kb, cat: sum(k == kb and i[0] == cat and s[0] == "active" and s[2] == "active" for (k, i), s in state.items())
    for r in sorted(requests, key=lambda r: (r[1], r[0])):
        target, origins, fields = (r[4], [(r[2], r[3])], r[5:]) if demoting else (r[2], r[3], r[4:])
        code = "schema_violation" if len(fields[3]) < 50 or not origins else None
        if not code and not demoting and (len(origins) < 2 or len({k for k, _ in origins}) < len(origins)):
            code = "invalid_origin_count"
        for o in [] if code else origins:
            s = state.get(tuple(o))
            if s is None or s[0] != "active" or s[2] != "active":
                code = "origin_not_found"
            elif s[1] != ("universal" if demoting else "unverified"):
                code = "origin_not_unverified"
            if code:
                break
        if not code:
            way = chain(target if demoting else origins[0][0], dirs)
            if demoting and (not way or way[0] != target or way[-1] == target or way[-1] != origins[0][0]):
                code = "target_kb_not_child"
            elif not demoting and (not way or way[-1] != target):
                code = "target_kb_not_root"
        letter = {"decision": "D", "learning": "L"}[fields[0]]
        last = max((int(i[2:]) for k, i in state if k == target and i[0] == letter), default=0)
        code = code or ("target_kb_full" if active(target, letter) >= 10 else "id_exhausted" if last >= 999 else "cross_kb_id_format_error" if not demoting and any(k == target for k, _ in origins) else None)
        if not code:
            for o in origins:
                state[tuple(o)] = ["archived", "", "archive"] if demoting else ["superseded", "", "active"]
            state[target, f"{letter}-{last + 1:03d}"] = ["active", "app-specific" if demoting else "universal", "active"]
        out[r[0]] = code or f"{letter}-{last + 1:03d}"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_promotions_equal_a_walk_in_order(spark, seed):
    draw = random.Random(seed)
    dirs = ["/p", "/p/a", "/p/a/b", "/p/c", "/q", "/q/a", "/lone"]
    held = [item(f"{d}/.kb", f"{c}-{i:03d}", draw.choice(["active"] * 9 + ["deprecated"]), draw.choice(["unverified"] * 9 + ["universal"]), draw.choice(["active"] * 9 + ["archive"])) for d in dirs for c in "DL" for i in range(1, draw.choice([4, 7] if d.count("/") == 1 else [20, 30]))]
    held += [item("/q/.kb", "L-998", "deprecated")]
    keys = [(i[0], i[1]) for i in held] + [("/p/a/.kb", "D-900"), ("/none/.kb", "D-001")]
    requests = []
    for i in range(220):
        # few origins, so that many requests share them, also across roots
        origins = draw.sample(keys[: 60 if i % 3 else None], draw.choice([0, 1, 2, 2, 2, 2, 2, 2, 3]))
        roots = ["/p/.kb", "/q/.kb", "/p/a/.kb", "/lone/.kb", "/none/.kb"]
        target = (chain(origins[0][0], dirs) or roots)[-1] if origins and draw.random() < 0.9 else draw.choice(roots)
        requests.append((i, draw.randint(0, 150), target, origins, *new(draw.choice(["decision", "learning"]), body=draw.choice([BODY] * 9 + ["short"]))))
    want = walk(requests, held, dirs)
    registry, stops = tables(spark, dirs)
    frame = spark.createDataFrame(held, ITEM)
    asked = spark.createDataFrame(requests, PROMOTE)
    got = {r.req_id: r.code or r.item_id for r in moves.promotion_verdicts(asked, frame, registry, stops).collect()}
    assert got == want and len({c for c in want.values() if "_" in c}) >= 6
    after = moves.promoted(frame, asked, F.lit(NOW), registry, stops).select("kb_path", "item_id").collect()
    made = [(r[2], want[r[0]]) for r in requests if "_" not in want[r[0]]]
    assert sorted(map(tuple, after)) == sorted([*((i[0], i[1]) for i in held), *made]) and len(made) > 10


def test_requests_for_other_roots_do_not_share_an_origin(spark):
    dirs = ["/r1", "/r1/a", "/r2", "/r2/a"]
    held = spark.createDataFrame([item("/r1/a/.kb", "D-001"), item("/r2/a/.kb", "D-001"), item("/r2/a/.kb", "D-002")], ITEM)
    one, two, three = ("/r1/a/.kb", "D-001"), ("/r2/a/.kb", "D-001"), ("/r2/a/.kb", "D-002")
    requests = spark.createDataFrame([(1, 1, "/r1/.kb", [one, two], *new()), (2, 2, "/r2/.kb", [two, one], *new()), (3, 3, "/r2/.kb", [three, ("/r1/.kb", "D-001")], *new())], PROMOTE)
    registry, stops = tables(spark, dirs)
    assert {r.req_id: r.code or r.item_id for r in moves.promotion_verdicts(requests, held, registry, stops).collect()} == {1: "D-001", 2: "origin_not_found", 3: "origin_not_found"}
    after = moves.promoted(held, requests, F.lit(NOW), registry, stops).collect()
    assert sorted((r.kb_path, r.item_id, r.status) for r in after) == [("/r1/.kb", "D-001", "active"), ("/r1/a/.kb", "D-001", "superseded-by-cross:..:D-001"), ("/r2/a/.kb", "D-001", "superseded-by-cross:../../r1:D-001"), ("/r2/a/.kb", "D-002", "active")]


def test_promoted_rows(spark):
    registry, stops = tables(spark, ["/p", "/p/a", "/p/a/b", "/p/c", "/top"], ["/p"])
    held = spark.createDataFrame([item("/p/a/b/.kb", "D-001"), item("/p/c/.kb", "D-004"), item("/p/.kb", "L-001")], ITEM)
    given = new("learning", "a-new-one", paths=["/p/x.py", "y.py", "/p/a/z.py", "/p/c/in.py", "/away", " "], severity="critical")
    requests = spark.createDataFrame([(1, 1, "/p/.kb", [("/p/a/b/.kb", "D-001"), ("/p/c/.kb", "D-004")], *given)], PROMOTE)
    after = {(r.kb_path, r.item_id): r for r in moves.promoted(held, requests, F.lit(NOW), registry, stops).collect()}
    made = after["/p/.kb", "L-002"]
    # only KBs on the first origin's way up mask the root's area
    assert (made.title, made.universality, made.status, made.severity, made.paths, made.created, made.body) == ("A new one", "universal", "active", None, ["x.py", "y.py", "c/in.py"], NOW, BODY)
    assert after["/p/a/b/.kb", "D-001"].status == "superseded-by-cross:../..:L-002" and after["/p/a/b/.kb", "D-001"].body == f"{BODY}\n\n## History\n\n- {NOW}: promoted to root KB as L-002"
    assert after["/p/c/.kb", "D-004"].updated == NOW and len(after) == 4


@pytest.mark.parametrize("seed", range(2))
def test_demotions_equal_a_walk_in_order(spark, seed):
    draw = random.Random(seed)
    dirs = ["/p", "/p/a", "/p/a/b", "/p/c", "/q", "/q/a"]
    held = [item(f"{d}/.kb", f"{c}-{i:03d}", draw.choice(["active"] * 5 + ["deprecated"]), draw.choice(["universal"] * 4 + ["unverified"])) for d in dirs for c in "DL" for i in range(1, draw.choice([9, 13, 3]))]
    held += [item("/p/c/.kb", "L-999", "deprecated", "universal")]
    keys = [(i[0], i[1]) for i in held] + [("/p/.kb", "D-900")]
    roots = [k for k in keys if k[0] in ("/p/.kb", "/q/.kb")]
    requests = [(i, draw.randint(0, 60), *draw.choice(roots if i % 5 else keys), draw.choice([f"{d}/.kb" for d in dirs] * 2 + ["/none/.kb"]), *new(draw.choice(["decision", "learning"]), body=draw.choice([BODY] * 9 + ["short"]))) for i in range(120)]
    want = walk(requests, held, dirs, demoting=True)
    registry, stops = tables(spark, dirs)
    got = {r.req_id: r.code or r.item_id for r in moves.demotion_verdicts(spark.createDataFrame(requests, DEMOTE), spark.createDataFrame(held, ITEM), registry, stops).collect()}
    assert got == want and {"origin_not_found", "origin_not_unverified", "target_kb_not_child", "schema_violation"} <= set(want.values())


def test_a_refused_first_request_leaves_the_item_to_the_second(spark):
    registry, stops = tables(spark, ["/p", "/p/a", "/p/b", "/q"])
    full = [item("/p/a/.kb", f"D-{i:03d}") for i in range(1, 11)]
    held = spark.createDataFrame([item("/p/.kb", "D-001", universality="universal"), *full], ITEM)
    rows = [(1, 1, "/p/.kb", "D-001", "/p/a/.kb", *new()), (2, 2, "/p/.kb", "D-001", "/q/.kb", *new()), (3, 3, "/p/.kb", "D-001", "/p/b/.kb", *new("learning", "moved-down", paths=["/p/b/f.py", "/p/g.py"])), (4, 4, "/p/.kb", "D-001", "/p/b/.kb", *new())]
    requests = spark.createDataFrame(rows, DEMOTE)
    assert {r.req_id: r.code or r.item_id for r in moves.demotion_verdicts(requests, held, registry, stops).collect()} == {1: "target_kb_full", 2: "target_kb_not_child", 3: "L-001", 4: "origin_not_found"}
    after = {(r.kb_path, r.item_id): r for r in moves.demoted(held, requests, F.lit(NOW), registry, stops).collect()}
    old, made = after["/p/.kb", "D-001"], after["/p/b/.kb", "L-001"]
    assert (old.status, old.location, old.archived_at, old.archive_reason) == ("archived", "archive", NOW, "demoted to b:L-001") and old.body.endswith(f"## History\n\n- {NOW}: demoted to child KB b as L-001")
    assert (made.slug, made.universality, made.paths) == ("moved-down", "app-specific", ["f.py"]) and made.body.endswith(f"- {NOW}: demoted from root KB (was D-001)") and len(after) == 12


def test_empty_tables(spark):
    registry, stops = tables(spark, ["/p"])
    nothing = spark.createDataFrame([], ITEM)
    asked = spark.createDataFrame([(1, 1, "/p/.kb", [("/p/.kb", "D-001"), ("/q/.kb", "D-001")], *new())], PROMOTE)
    assert [r.code for r in moves.promotion_verdicts(asked, nothing, registry, stops).collect()] == ["origin_not_found"]
    assert moves.promoted(nothing, spark.createDataFrame([], PROMOTE), F.lit(NOW), registry, stops).count() == 0
    assert moves.demoted(nothing, spark.createDataFrame([], DEMOTE), F.lit(NOW), registry, stops).count() == 0
