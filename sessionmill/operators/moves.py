"""Promotions of items to the root KB of their chain, and demotions back to a child KB.

Requests count in one order over all KBs. What an accepted request takes as an
origin is no longer active for those after it, wherever they would move it to; it
takes a place in its target's category and frees one in its origins' categories. So a
request may depend on others far away, but only on earlier ones that share an origin
or a category with it. ``granted`` decides them in rounds of joins: in each round
all requests at once that no undecided earlier one can still change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.functions.paths import kept_within, relative
from sessionmill.functions.tables import Steps
from sessionmill.functions.text import category_letter, category_of_letter, title_of_slug, with_history
from sessionmill.operators.items import MOST_IDS, written_verdict
from sessionmill.operators.regions import chain_up
from sessionmill.operators.similarity import CAP

PLACE = ["target_kb", "category"]
TAKES = "array<struct<kb_path:string,item_id:string>>"


def _live() -> Column:
    return F.coalesce((F.col("status") == "active") & (F.col("location") == "active"), F.lit(False))


def _places(items: DataFrame) -> DataFrame:
    """target_kb, category, active, last_id of every category that has items."""
    return items.groupBy(F.col("kb_path").alias("target_kb"), "category").agg(F.count_if(_live()).alias("active"), F.max(F.substring("item_id", 3, 3).cast("int")).alias("last_id"))


def _origin(takes: str = "take") -> list[Column]:
    return [F.col(f"{takes}.kb_path").alias("target_kb"), category_of_letter(F.left(f"{takes}.item_id", F.lit(1))).alias("category")]


def _filled(wanted: DataFrame, given: DataFrame | None, places: DataFrame) -> DataFrame:
    """``wanted`` with ``before``, the requests granted in its place before it, and the places and ids left for it then.

    A category takes few requests, so the orders of those that it took, and of those
    that took from it, are short lists.
    """
    out = wanted.join(places, PLACE, "left")
    none = F.array().cast(f"array<{wanted.schema['at'].dataType.simpleString()}>")
    if given is None:
        out = out.withColumns({"came": none, "went": none})
    else:
        came = given.groupBy(*PLACE).agg(F.collect_list("at").alias("came"))
        went = given.select("at", F.explode("takes").alias("take")).select("at", *_origin()).groupBy(*PLACE).agg(F.collect_list("at").alias("went"))
        out = out.join(came, PLACE, "left").join(went, PLACE, "left")
    earlier = lambda c: F.coalesce(F.size(F.filter(c, lambda a: a < F.col("at"))), F.lit(0))
    out = out.withColumn("before", F.greatest(earlier("came"), F.lit(0))).withColumn("freed", F.greatest(earlier("went"), F.lit(0)))
    room = F.lit(CAP) - F.coalesce("active", F.lit(0)) - F.col("before") + F.col("freed")
    return out.withColumns({"room": room, "ids": F.lit(MOST_IDS) - F.coalesce("last_id", F.lit(0)) - F.col("before")}).drop("came", "went", "freed", "active")


def granted(wanted: DataFrame, places: DataFrame, steps: Steps) -> DataFrame:
    """Those of ``wanted(req_id, at, target_kb, category, takes)`` that are granted if they come one after the other in the order of ``at``.

    A request is granted if no earlier granted one took any of ``takes`` (struct(kb_path,
    item_id)) and its category has a place and an id left. A round grants the requests
    that are the first undecided ones for all they take and would have a place even if
    all undecided ones before them got one, and refuses those that find an origin taken
    or no place left; the first undecided request of all is decided in any case. Of a
    category, no more than CAP undecided requests can have a place, so only the first of
    these are looked at. There are as many rounds as the longest chain of requests of
    which each waits for the one before.
    """
    undecided, given = steps.store(wanted, "undecided"), None
    while not undecided.isEmpty():
        told = _filled(undecided, given, places)
        each = undecided.select("req_id", "at", F.explode("takes").alias("take"))
        # a place that is full may be freed by an undecided request, if that comes earlier
        frees = each.select("at", *_origin()).groupBy(*PLACE).agg(F.min("at").alias("frees"))
        told = told.join(frees, PLACE, "left")
        full = (F.col("room") <= 0) & ~F.coalesce(F.col("frees") < F.col("at"), F.lit(False))
        told = told.where(~(full | (F.col("ids") <= 0)))
        if given is not None:
            taken = given.select(F.explode("takes").alias("take")).distinct()
            late = each.join(taken, "take", "left_semi").select("req_id").distinct()
            told = told.join(late, "req_id", "left_anti")
        left = steps.store(told.select(*wanted.columns, "room", "ids"), "left")
        each = left.select("req_id", "at", F.explode("takes").alias("take"))
        first = each.groupBy("take").agg(F.min("at").alias("first"))
        turn = F.row_number().over(Window.partitionBy(*PLACE).orderBy("at"))
        near = left.withColumn("turn", turn).where(F.col("turn") <= CAP).where((F.col("turn") <= F.col("room")) & (F.col("turn") <= F.col("ids"))).select(*wanted.columns)
        waits = near.select("req_id", "at", F.explode("takes").alias("take")).join(first, "take").where(F.col("first") != F.col("at")).select("req_id").distinct()
        now = near.join(waits, "req_id", "left_anti")
        now = steps.store(now if given is None else given.unionByName(now), "given")
        undecided = steps.store(left.select(*wanted.columns).join(now.select("req_id"), "req_id", "left_anti"), "undecided")
        given = now
    steps.drop("left")
    return given if given is not None else wanted.limit(0)


def _numbered(known: DataFrame, given: DataFrame, places: DataFrame, own: list[Column], last: list[Column]) -> DataFrame:
    """req_id, code, item_id: refusals in their order, ``own`` before and ``last`` after the want of places and ids."""
    told = _filled(known, given, places)
    full = F.when(F.col("room") <= 0, "target_kb_full").when(F.col("ids") <= 0, "id_exhausted")
    number = F.coalesce("last_id", F.lit(0)) + F.col("before") + 1
    code = F.coalesce(*own, full, *last)
    item_id = F.concat(category_letter(F.col("category")), F.lit("-"), F.lpad(number.cast("string"), 3, "0"))
    return told.select("req_id", code.alias("code"), F.when(code.isNull(), item_id).alias("item_id"))


def promotion_verdicts(requests: DataFrame, items: DataFrame, registry: DataFrame, boundaries: DataFrame) -> DataFrame:
    """req_id, code, item_id of requests to make one universal item of several unverified ones.

    ``requests`` has req_id, req_order, target_kb, origins (array of struct(kb_path,
    item_id)) and the new item's category, title_slug, summary, body, tags, paths,
    severity; ``registry`` kb_path and kb_dir; ``boundaries(dir)`` ends chains. Codes, the
    first that holds: schema_violation of the item's fields or without origins;
    invalid_origin_count with one origin or a KB twice; origin_not_found or
    origin_not_unverified of the first origin that is not active and unverified when
    its request's turn comes; target_kb_not_root unless the target is the last KB of the
    first origin's chain; target_kb_full, id_exhausted; cross_kb_id_format_error if an origin is
    in the target KB. A refused request changes nothing for later ones.
    """
    return _promotions(requests, items, registry, boundaries)[0]


def _promotions(requests: DataFrame, items: DataFrame, registry: DataFrame, boundaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdicts; and req_id, root, mask of every request: the root of its first origin's chain, and the directory of the chain's last KB before it."""
    steps = Steps(items.sparkSession, "promotions")
    state = items.select("kb_path", "item_id", "status", "universality", F.col("location") == "active").toDF("kb_path", "item_id", "status", "universality", "here")
    # where an id is held twice the active one counts
    held = state.groupBy("kb_path", "item_id").agg(F.max_by(F.struct("status", "universality", "here"), "here").alias("held"))
    each = requests.select("req_id", "req_order", F.posexplode("origins").alias("place", "o")).select("req_id", F.struct("req_order", "req_id").alias("at"), "place", "o.kb_path", "o.item_id").join(held, ["kb_path", "item_id"], "left")
    live = F.coalesce((F.col("held.status") == "active") & F.col("held.here"), F.lit(False))
    each = each.withColumn("wrong", F.when(~live, "origin_not_found").when(F.col("held.universality") != "unverified", "origin_not_unverified"))
    dirs = registry.select("kb_path", F.col("kb_dir").alias("origin_dir"))
    each = steps.store(each.join(dirs, "kb_path", "left").drop("held"), "origins")
    # the chain of each first origin's KB
    firsts = each.where("place = 0").select("req_id", F.col("origin_dir").alias("cwd"))
    up = chain_up(firsts.where("cwd IS NOT NULL"), registry, boundaries).groupBy("cwd").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("down"), "kb_path", "kb_dir"))).alias("chain"))
    roots = firsts.join(up, "cwd").select("req_id", F.get("chain", F.lit(0))["kb_path"].alias("root"), F.get("chain", F.lit(1))["kb_dir"].alias("mask"))
    sums = each.groupBy("req_id").agg(F.count("*").alias("n"), F.count_distinct("kb_path").alias("n_kbs"), F.max(F.col("wrong").isNotNull()).alias("unsound"))
    known = requests.withColumn("at", F.struct("req_order", "req_id")).withColumn("bad", written_verdict()).join(sums, "req_id", "left").join(roots, "req_id", "left")
    count = F.when(F.col("n").isNull(), "schema_violation").when((F.col("n") < 2) | (F.col("n_kbs") < F.col("n")), "invalid_origin_count")
    away = F.when(~F.coalesce(F.col("root") == F.col("target_kb"), F.lit(False)), "target_kb_not_root")
    # origins of the target itself cannot be told apart by a path from it
    inside = F.when(F.exists("origins", lambda o: o["kb_path"] == F.col("target_kb")), "cross_kb_id_format_error")
    known = known.withColumns({"count": F.coalesce("bad", count), "away": away, "inside": inside})
    known = steps.store(known.select("req_id", "at", *PLACE, F.col("origins").cast(TAKES).alias("takes"), "count", "unsound", "away", "inside", "root", "mask"), "known")
    places = _places(items)
    sound = known.where("count IS NULL AND NOT unsound AND away IS NULL AND inside IS NULL").select("req_id", "at", *PLACE, "takes")
    given = granted(sound, places, steps)
    taken = given.select(F.col("at").alias("taken_at"), F.explode("takes").alias("o")).select("taken_at", "o.kb_path", "o.item_id")
    late = F.when(F.col("taken_at") < F.col("at"), "origin_not_found")
    wrong = each.join(taken, ["kb_path", "item_id"], "left").withColumn("fails", F.coalesce(late, "wrong")).where("fails IS NOT NULL").groupBy("req_id").agg(F.min_by("fails", "place").alias("wrong"))
    verdicts = _numbered(known.join(wrong, "req_id", "left"), given, places, [F.col("count"), F.col("wrong"), F.col("away")], [F.col("inside")])
    return verdicts, known.select("req_id", "root", "mask")


def _new_items(accepted: DataFrame, columns: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Rows of the new items, with the columns of ``columns``; what is not made comes from the request, else it is null."""
    made = {"kb_path": F.col("target_kb"), "item_id": F.col("new_id"), "slug": F.col("title_slug"), "title": title_of_slug(F.col("title_slug")), "status": F.lit("active"), "location": F.lit("active"), "severity": F.when(F.col("category") == "anti-pattern", F.col("severity"))} | made
    known = {"category", "summary", "tags", "body"}
    return accepted.select(*[made.get(c, F.col(c) if c in known else F.lit(None)).cast(columns.schema[c].dataType).alias(c) for c in columns.columns])


def promoted(items: DataFrame, requests: DataFrame, now: Column, registry: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The next snapshot: accepted requests' new universal items in the root KBs, and their origins superseded, with a history line.

    Paths outside the root's directory, or inside the area of a KB of the first
    origin's chain, are dropped.
    """
    verdicts, chain = _promotions(requests, items, registry, boundaries)
    verdicts = verdicts.where("code IS NULL").select("req_id", F.col("item_id").alias("new_id"))
    dirs = registry.select("kb_path", "kb_dir")
    accepted = requests.join(verdicts, "req_id").join(chain, "req_id").join(dirs.withColumnsRenamed({"kb_path": "target_kb", "kb_dir": "target_dir"}), "target_kb")
    origins = accepted.select("new_id", "target_dir", F.explode("origins").alias("o")).select("new_id", "target_dir", "o.*").join(dirs, "kb_path")
    both = items.join(origins, ["kb_path", "item_id"], "left")
    hit = F.col("new_id").isNotNull() & (F.col("location") == "active")
    new = {
        "status": F.concat(F.lit("superseded-by-cross:"), relative(F.col("kb_dir"), F.col("target_dir")), F.lit(":"), F.col("new_id")),
        "updated": now,
        "body": with_history(F.col("body"), F.concat(now, F.lit(": promoted to root KB as "), F.col("new_id"))),
    }
    changed = both.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])
    paths = kept_within(F.col("paths"), F.col("target_dir"), F.col("mask"))
    return changed.unionByName(_new_items(accepted, items, {"universality": F.lit("universal"), "created": now, "updated": now, "paths": paths}))


def demotion_verdicts(requests: DataFrame, items: DataFrame, registry: DataFrame, boundaries: DataFrame) -> DataFrame:
    """req_id, code, item_id of requests to move one universal root item down to a child KB.

    ``requests`` has req_id, req_order, origin_kb, origin_id, target_kb and the new
    item's fields as for promotions. Codes, the first that holds: schema_violation;
    origin_not_found, origin_not_unverified (which stands for an item that is not universal);
    target_kb_not_child unless the target is a KB whose chain ends in the origin's KB and
    is not that KB; target_kb_full, id_exhausted.
    """
    steps = Steps(items.sparkSession, "demotions")
    held = items.groupBy(F.col("kb_path").alias("origin_kb"), F.col("item_id").alias("origin_id")).agg(F.max_by(F.struct("universality", _live().alias("live")), F.col("location") == "active").alias("held"))
    dirs = registry.select(F.col("kb_path").alias("target_kb"), F.col("kb_dir").alias("cwd"))
    up = chain_up(dirs, registry, boundaries).groupBy("cwd").agg(F.max_by("kb_path", F.struct("steps", "kb_path")).alias("root"))
    known = requests.withColumn("at", F.struct("req_order", "req_id")).withColumn("bad", written_verdict()).join(held, ["origin_kb", "origin_id"], "left").join(dirs.join(up, "cwd"), "target_kb", "left")
    unsound = F.when(~F.coalesce("held.live", F.lit(False)), "origin_not_found").when(F.col("held.universality") != "universal", "origin_not_unverified")
    child = F.coalesce((F.col("root") == F.col("origin_kb")) & (F.col("root") != F.col("target_kb")), F.lit(False))
    takes = F.array(F.struct(F.col("origin_kb").alias("kb_path"), F.col("origin_id").alias("item_id")))
    known = known.select("req_id", "at", *PLACE, takes.cast(TAKES).alias("takes"), "bad", unsound.alias("unsound"), F.when(~child, "target_kb_not_child").alias("away"))
    known = steps.store(known, "known")
    places = _places(items)
    given = granted(known.where("bad IS NULL AND unsound IS NULL AND away IS NULL").select("req_id", "at", *PLACE, "takes"), places, steps)
    taken = given.select(F.col("at").alias("taken_at"), "takes")
    late = F.when(F.col("taken_at") < F.col("at"), "origin_not_found")
    return _numbered(known.join(taken, "takes", "left"), given, places, [F.col("bad"), late, F.col("unsound"), F.col("away")], [])


def demoted(items: DataFrame, requests: DataFrame, now: Column, registry: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The next snapshot: each accepted root item is archived, and a new item of the request's content is specific to its target KB; both have a history line."""
    verdicts = demotion_verdicts(requests, items, registry, boundaries).where("code IS NULL").select("req_id", F.col("item_id").alias("new_id"))
    dirs = [registry.select(F.col("kb_path").alias(f"{k}_kb"), F.col("kb_dir").alias(f"{k}_dir")) for k in ("origin", "target")]
    accepted = reduce(lambda df, d: df.join(d, d.columns[0]), dirs, requests.join(verdicts, "req_id"))
    moved = accepted.select(F.col("origin_kb").alias("kb_path"), F.col("origin_id").alias("item_id"), "new_id", relative(F.col("origin_dir"), F.col("target_dir")).alias("link"))
    both = items.join(moved, ["kb_path", "item_id"], "left")
    hit = F.col("new_id").isNotNull() & (F.col("location") == "active")
    old = {
        "status": F.lit("archived"),
        "archived_at": now,
        "archive_reason": F.concat(F.lit("demoted to "), F.col("link"), F.lit(":"), F.col("new_id")),
        "location": F.lit("archive"),
        "updated": now,
        "body": with_history(F.col("body"), F.concat(now, F.lit(": demoted to child KB "), F.col("link"), F.lit(" as "), F.col("new_id"))),
    }
    changed = both.select(*[F.when(hit, old[c]).otherwise(F.col(c)).alias(c) if c in old else F.col(c) for c in items.columns])
    body = with_history(F.col("body"), F.concat(now, F.lit(": demoted from root KB (was "), F.col("origin_id"), F.lit(")")))
    made = {"universality": F.lit("app-specific"), "created": now, "updated": now, "body": body, "paths": kept_within(F.col("paths"), F.col("target_dir"))}
    return changed.unionByName(_new_items(accepted, items, made))
