import random

import numpy as np

from sessionmill.llm.components import components
from sessionmill.llm.near_dedup import confirmed, local_components, near_duplicates


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def shingles(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower(text or "")).split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n=30, seed=1):
    draw, rows = random.Random(seed), []
    for g in range(n):
        words = [draw.choice("abcdefghij") * draw.randint(1, 4) + str(draw.randint(0, 30)) for _ in range(draw.choice([3, 5, 12, 60, 200]))]
        for _ in range(draw.choice([1, 1, 3, 12])):
            own = list(words)
            for _ in range(draw.choice([0, 0, 1, 2, 6])):
                own[draw.randrange(len(own))] = f"new{draw.random()}"
            rows.append(" ".join(own))
    shared = " ".join(f"p{i}" for i in range(40))
    rows += [f"{shared} " + " ".join(f"own{k}x{i}" for i in range(10)) for k in range(25)]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, " \t\n"), (903, "x y"), (904, "X  Y"), (905, "w " * 20_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    want = brute(rows)
    # small limits make nodes branch, and clusters fall into blocks
    for settings in ({}, {"node_limit": 8, "block_limit": 5, "levels": 3}):
        got = near_duplicates(df, **settings).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_no_link_is_lost_in_large_nodes(spark):
    """Thousands of texts share a passage whose minwise tokens put them into the same nodes at every level; near copies among them are still found."""
    draw = random.Random(5)
    shared = [f"p{i}" for i in range(120)]
    rows = []
    for k in range(1500):
        own = [*shared, *[f"o{k}x{i}" for i in range(60)]]
        rows.append(" ".join(own))
        own[draw.randrange(130, 170)] = "changed"
        rows.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, node_limit=64, block_limit=200).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}


def test_rows_without_ids_and_repeated_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (7, 5, False)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (60, 50), (60, 55)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 50: 50, 55: 50, 60: 50}


def test_local_helpers():
    linked = np.array([[1, 0, 1, 0], [0, 1, 0, 0], [1, 0, 1, 1], [0, 0, 1, 1]], bool)
    assert local_components(linked).tolist() == [0, 1, 0, 0]
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [9], [1, 2, 3])]
    assert np.argwhere(np.triu(confirmed(sets, 80), 1)).tolist() == [[0, 1]]
