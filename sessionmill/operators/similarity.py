"""Similar items within a KB, and items that several KBs share.

``items`` has kb_path, item_id, category, slug, status, tags, paths, universality,
updated; ``candidates`` has candidate_id, kb_path, category, title_slug, tags, paths.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import sessionmill
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.functions.distance import Strings, code_points
from sessionmill.functions.tables import Steps
from sessionmill.functions.text import js_len

SLUG_DISTANCE = 0.4
CAP = 10
#: Decimal places of a score that decide its rank.
SCORE_PLACES = 9
#: Classes of a block, and those of it that are compared at a time.
BLOCK, RUN = 16_000, 512
#: Items of one class that meet another class in a task.
PART = 1000
#: Tasks that compare, at most; each has several units beyond that.
MOST_PARTS = 10_000


def slug_distance(a: Column, b: Column) -> Column:
    """Edit distance by the longer length, 0 to 1."""
    longer = F.greatest(js_len(a), js_len(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)


def active_counts(items: DataFrame) -> DataFrame:
    """kb_path, category, active, remaining of the CAP places."""
    counts = items.groupBy("kb_path", "category").agg(F.count_if(F.col("status") == "active").alias("active"))
    return counts.withColumn("remaining", F.greatest(F.lit(CAP) - F.col("active"), F.lit(0)))


def similar(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Matches of each candidate among the active items of its KB and category, best first.

    A match shares two tags, or has a close slug, or shares a path and a tag.
    Scores that are equal to SCORE_PLACES places are equal, as sums of the same parts
    differ in their last bits; then the smaller item_id is better, and of items that
    share an id the one whose slug, tags and paths come first.
    Returns candidate_id, item_id, tag_overlap, slug_distance, path_overlap, score,
    reasons, rank. A KB has at most CAP active items of a category, so the join
    gives at most that many rows for each candidate.
    """
    held = items.where("status = 'active'").select("kb_path", "category", "item_id", F.col("slug").alias("item_slug"), F.col("tags").alias("item_tags"), F.col("paths").alias("item_paths"))
    pairs = candidates.where(F.size("tags") > 0).join(held, ["kb_path", "category"])
    pairs = pairs.withColumns(
        {
            "tag_overlap": F.size(F.array_intersect("tags", "item_tags")),
            "slug_distance": slug_distance(F.col("item_slug"), F.col("title_slug")),
            "path_overlap": F.coalesce(F.arrays_overlap("paths", "item_paths"), F.lit(False)),
        }
    )
    tags, near, path = F.col("tag_overlap") >= 2, F.col("slug_distance") <= SLUG_DISTANCE, F.col("path_overlap") & (F.col("tag_overlap") >= 1)
    reasons = F.array_compact(
        F.array(
            F.when(tags, F.format_string("tag_overlap_count=%d", "tag_overlap")),
            F.when(near, F.format_string(f"slug_distance_normalized=%.3f<={SLUG_DISTANCE}", "slug_distance")),
            F.when(path, F.format_string("path_overlap+tag_overlap_count=%d", "tag_overlap")),
        )
    )
    score = 0.4 * F.least(F.col("tag_overlap") / 3, F.lit(1.0)) + 0.4 * (1 - F.col("slug_distance")) + F.when(F.col("path_overlap"), 0.2).otherwise(0.0)
    found = pairs.where(tags | near | path).withColumns({"score": score, "reasons": reasons})
    rank = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc(F.round("score", SCORE_PLACES)), "item_id", "item_slug", "item_tags", "item_paths"))
    return found.select("candidate_id", "item_id", "tag_overlap", "slug_distance", "path_overlap", "score", "reasons", rank.alias("rank"))


def suggestions(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """candidate_id, action (create, merge, needs_eviction), best_match: what to do with each candidate."""
    best = similar(candidates, items).where("rank = 1").select("candidate_id", F.col("item_id").alias("best_match"))
    room = active_counts(items).select("kb_path", "category", "remaining")
    out = candidates.where(F.size("tags") > 0).join(best, "candidate_id", "left").join(room, ["kb_path", "category"], "left")
    action = F.when(F.col("best_match").isNotNull(), "merge").when(F.coalesce("remaining", F.lit(CAP)) > 0, "create").otherwise("needs_eviction")
    return out.select("candidate_id", action.alias("action"), "best_match")


def _near(row: dict[str, list], members: list[int], a: str, b: str, i: int, j: int, distance: float) -> tuple[np.ndarray, ...]:
    """Close pairs of blocks ``i`` and ``j`` of one tag pair, less those that share an earlier one: places of both in ``row``, shared tags, distances."""
    bit = {t: n for n, t in enumerate(sorted({t for at in members for t in row["tags"][at]}))}
    owner, k = np.array([(n, bit[t]) for n, at in enumerate(members) for t in row["tags"][at]], np.int64).T
    masks = np.zeros((len(members), len(bit) // 64 + 1), np.uint64)
    np.bitwise_or.at(masks, (owner, k // 64), np.left_shift(np.uint64(1), (k % 64).astype(np.uint64)))
    earlier = np.zeros(masks.shape[1], np.uint64)
    for k in set(range(bit[b])) - {bit[a]}:
        earlier[k // 64] |= np.uint64(1 << k % 64)
    # in the order of their earlier tags, as classes of the same ones leave out the same others, then of their slugs
    order = np.array(sorted(range(len(members)), key=lambda n: row["slug"][members[n]]), np.int64)
    order = order[np.lexsort((masks & earlier)[order].T)]
    place, masks = np.array(members)[order], masks[order]
    low, length, block = masks & earlier, *(np.array([row[c][at] for at in place]) for c in ("length", "block"))
    slugs = Strings([code_points(row["slug"][at]) for at in place], length)
    left, right = (np.flatnonzero(block == side) for side in (i, j))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    bounds = [*np.flatnonzero((low[left][1:] != low[left][:-1]).any(axis=1)) + 1, len(left)]
    for first, last in zip([0, *bounds], bounds, strict=False):
        own = left[first:last]
        if not len(own):
            continue
        others = right[((low[right] & low[own[0]]) == 0).all(axis=1)]
        if i == j:
            others = others[others > own[0]]
        # only classes without earlier tags meet each other: of these, each asks those behind it
        among = i == j and not low[own[0]].any()
        if not among and len(others) < len(own):
            own, others = others, own
        for begin in range(0, len(own), RUN):
            run = own[begin : begin + RUN]
            one, other, edits = slugs.distances(run, others[others > run[0]] if among else others, distance)
            longer = np.maximum(length[one], length[other])
            apart = np.where(longer == 0, 0.0, edits / np.maximum(longer, 1))
            near = (apart <= distance) & ((other > one) | (not among))
            one, other = one[near], other[near]
            found.append((place[one], place[other], np.bitwise_count(masks[one] & masks[other]).sum(axis=1, dtype=np.int64), apart[near]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _compared(distance: float) -> Callable[[pa.Table], pa.Table]:
    """The close pairs of a unit: of two blocks of a popular tag pair, or of many rare tag pairs."""

    def run(rows: pa.Table) -> pa.Table:
        row = {c: rows[c].to_pylist() for c in ("category", "a", "b", "key", "slug", "tags", "length", "block")}
        i, j = (rows[c][0].as_py() for c in ("i", "j"))
        groups = defaultdict(list)
        for at, group in enumerate(zip(row["category"], row["a"], row["b"], strict=True)):
            groups[group].append(at)
        found = [_near(row, members, a, b, i, j, distance) for (_, a, b), members in groups.items()]
        one, other, shared, apart = map(np.concatenate, zip(*found, strict=True))
        key = rows["key"].combine_chunks()
        return pa.table({"l_key": key.take(pa.array(one)), "key": key.take(pa.array(other)), "shared_tags": pa.array(shared, pa.int32()), "slug_distance": pa.array(apart)})

    return run


def promotion_pairs(items: DataFrame, distance: float = SLUG_DISTANCE, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Unverified active items of two KBs that share two tags and have close slugs: left_kb, left_id, right_kb, right_id, shared_tags, slug_distance.

    Items that are equal in category, slug and tags are one class, compared once. Classes
    meet on a pair of tags, of which one of five tags has ten, and are compared at the
    first pair that they share. The classes of a popular tag pair are dealt into blocks,
    and each two blocks are a unit of their own; rare tag pairs share units. So units are
    bounded and spread over all tasks, but popular pairs still cost the square of their
    classes. Items are joined to what is close, those of large classes in parts.
    """
    cloudpickle.register_pickle_by_value(sessionmill)
    steps = Steps(items.sparkSession, "pairs")
    own = items.where("status = 'active' AND universality = 'unverified'").select("kb_path", "item_id", "category", "slug", F.array_sort(F.array_distinct(F.array_compact("tags"))).alias("tags"))
    # asked before they are stored, the number of tags would be worked out where items are read, and the tags again for each of its parts
    own = steps.store(own.withColumn("key", F.md5(F.to_json(F.struct("category", "slug", "tags")))), "items").where(F.size("tags") >= 2)
    classes = steps.store(own.where("category IS NOT NULL AND slug IS NOT NULL").select("key", "category", "slug", "tags").distinct().withColumn("length", js_len(F.col("slug"))), "classes")
    pairs = F.flatten(F.transform("tags", lambda a: F.transform(F.filter("tags", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    tag = classes.withColumn("pair", F.explode(pairs)).select("*", "pair.a", "pair.b").drop("pair")
    group, rare = ["category", "a", "b"], F.col("blocks") == 1
    groups = steps.store(tag.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block)), "groups")
    size = groups.agg(F.sum(F.when(rare, F.col("n"))).alias("rare"), F.sum(F.when(~rare, F.col("blocks") * (F.col("blocks") + 1) / 2)).alias("popular")).first()
    shared_units = -(-(size["rare"] or 0) // block)
    met = tag.join(groups, group).withColumn("unit", F.when(rare, F.pmod(F.xxhash64(*group), F.lit(max(1, shared_units)))).otherwise(F.xxhash64(*group)))
    met = met.withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.select("unit", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), *group, "key", "slug", "tags", "length", "block")
    # units are few rows and much work: a number of partitions is named, so that they are not put together by their bytes
    parts = max(items.sparkSession.sparkContext.defaultParallelism, min(shared_units + int(size["popular"] or 0), MOST_PARTS))
    close = met.repartition(parts, "unit", "i", "j").groupBy("unit", "i", "j").applyInArrow(_compared(distance), "l_key string, key string, shared_tags int, slug_distance double")
    same = classes.select(F.col("key").alias("l_key"), "key", F.size("tags").alias("shared_tags"), F.lit(0.0).alias("slug_distance"))
    close = steps.store(close.unionByName(same), "close")
    one, other = (own.select(F.col("key").alias(k), F.struct("kb_path", "item_id").alias(n)) for k, n in (("l_key", "one"), ("key", "other")))
    # a class of many copies is dealt into parts, each of which meets the items of the other class
    parts = own.groupBy(F.col("key").alias("l_key")).agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1")
    parts = steps.store(close.join(parts, "l_key").groupBy("key").agg(F.max("parts").alias("parts")), "parts")
    dealt = F.coalesce("parts", F.lit(1))
    one = close.join(one, "l_key").join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("one"), dealt)).drop("parts")
    other = other.join(parts, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), dealt - 1))).drop("parts")
    both = one.join(other, ["key", "part"]).where((F.col("one.kb_path") < F.col("other.kb_path")) | (F.col("l_key") != F.col("key")) & (F.col("one.kb_path") > F.col("other.kb_path")))
    left, right = F.least("one", "other"), F.greatest("one", "other")
    return both.select(left["kb_path"].alias("left_kb"), left["item_id"].alias("left_id"), right["kb_path"].alias("right_kb"), right["item_id"].alias("right_id"), "shared_tags", "slug_distance")


def promotion_groups(pairs: DataFrame) -> DataFrame:
    """The partners of each anchor item: kb_path, item_id, partners, n_kbs."""
    partner = F.struct(F.col("right_kb").alias("kb_path"), F.col("right_id").alias("item_id"))
    grouped = pairs.groupBy(F.col("left_kb").alias("kb_path"), F.col("left_id").alias("item_id")).agg(F.array_sort(F.collect_set(partner)).alias("partners"))
    return grouped.withColumn("n_kbs", F.size(F.array_distinct(F.transform("partners", lambda p: p["kb_path"]))) + 1)


def demotion_hints(items: DataFrame, root_kb: str, least: int = 2) -> DataFrame:
    """Root items marked universal whose paths another KB's items share at least ``least`` times: root_id, kb_path, overlaps."""
    live = items.where("status = 'active'").select("kb_path", "item_id", "universality", F.explode("paths").alias("path"))
    root = live.where((F.col("kb_path") == root_kb) & (F.col("universality") == "universal")).select(F.col("item_id").alias("root_id"), "path").distinct()
    child = live.where(F.col("kb_path") != root_kb).select("kb_path", "item_id", "path").distinct()
    return root.join(child, "path").groupBy("root_id", "kb_path").agg(F.count("*").alias("overlaps")).where(F.col("overlaps") >= least)
