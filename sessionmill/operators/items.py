"""Changes to knowledge items: each takes a snapshot and requests, and gives accepted and refused rows or the next snapshot.

``items`` has kb_path, item_id, category, slug, title, summary, tags, paths, status,
universality, severity, created, updated, archived_at, archive_reason, location
(active or archive), body.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import sessionmill
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.functions.paths import dropped_outside, kept_within
from sessionmill.functions.tables import Steps
from sessionmill.functions.text import CATEGORIES, SEVERITIES, UNIVERSALITIES, category_letter, js_len, title_of_slug, with_history
from sessionmill.operators.candidates import HEADING, SLUG, TAG
from sessionmill.operators.regions import kept_of, kept_paths, path_owners
from sessionmill.operators.similarity import CAP, active_counts

MOST_IDS = 999
GROUP = ["kb_path", "category"]
#: What follows superseded-by is not looked at here.
STATUS = r"(?s)^(active|deprecated|archived|superseded-by:.+|superseded-by-cross:.+)\z"


def item_error() -> Column:
    """The first field of a stored item that is not as it should be, or null."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(F.col("item_id").rlike(r"^[DLRA]-[0-9]{3}\z")), "id")
        .when(no(F.col("category").isin(*[c[0] for c in CATEGORIES])), "type")
        .when(no(F.col("title") != ""), "title")
        .when(no(F.col("summary") != ""), "summary")
        .when(no(F.col("tags").isNotNull()), "tags")
        .when(no(F.col("paths").isNotNull()), "paths")
        .when(no(F.col("status").rlike(STATUS)), "status")
        .when(no(F.col("universality").isin(*UNIVERSALITIES)), "universality")
        .when(no(F.col("created") != ""), "created")
        .when(no(F.col("updated") != ""), "updated")
        .when(F.col("severity").isNotNull() & ~F.col("severity").isin(*SEVERITIES), "severity")
    )


def _bounds(slug: str, summary: str, body: str, tags: str) -> list[Column]:
    """What each field of a written item must be; null where the field is absent."""
    return [
        F.col(slug).rlike(SLUG) & (F.length(slug) <= 32),
        js_len(F.col(summary)).between(1, 60),
        js_len(F.col(body)).between(50, 8000) & F.col(body).rlike(HEADING),
        F.when(F.col(tags).isNotNull(), F.size(tags)).between(1, 5) & F.forall(tags, lambda t: F.coalesce(t.rlike(TAG), F.lit(False))),
    ]


def _violation(*sound: Column, absent: bool) -> Column:
    """schema_violation unless all of ``sound`` hold; ``absent`` tells what counts for a null."""
    bad = [~F.coalesce(c, F.lit(absent)) for c in sound]
    return F.when(reduce(lambda a, b: a | b, bad), "schema_violation")


def schema_verdict(slug: str = "title_slug", summary: str = "summary", body: str = "body", tags: str = "tags") -> Column:
    """schema_violation if a written item's fields are out of bounds, else null; absent fields pass."""
    return _violation(*_bounds(slug, summary, body, tags), absent=True)


def written_verdict(universality: str | None = None) -> Column:
    """schema_violation unless a new item has all its fields, in bounds; a severity counts for anti-patterns only, which need none."""
    severity = F.when(F.col("category") == "anti-pattern", F.col("severity").isNull() | F.col("severity").isin(*SEVERITIES)).otherwise(F.lit(True))
    sound = [*_bounds("title_slug", "summary", "body", "tags"), F.col("category").isin(*[c[0] for c in CATEGORIES]), F.forall("paths", lambda p: p.isNotNull()), severity]
    if universality:
        sound.append(F.col(universality).isin(*UNIVERSALITIES))
    return _violation(*sound, absent=False)


def patch_verdict(superseding: bool = False) -> Column:
    """Why an edit's own fields are refused, or null: the new body must be there, the other new fields may be; a note alone that is too short or too long is history_note_too_short."""
    given = _violation(
        js_len(F.col("new_summary")).between(1, 60), *_bounds("new_summary", "new_summary", "new_body", "new_tags")[3:], F.forall("new_paths", lambda p: p.isNotNull()),
        F.col("new_universality").isin(*UNIVERSALITIES), F.col("new_severity").isin(*SEVERITIES), absent=True,
    )
    body = _violation(js_len(F.col("new_body")).between(50, 8000) & F.col("new_body").rlike(HEADING), absent=False)
    note = F.when(~F.coalesce(js_len(F.col("history_note")).between(10, 200), F.lit(False)), "history_note_too_short")
    return F.coalesce(given, body, *([note] if superseding else []))


def reason_verdict(column: str, least: int, most: int) -> Column:
    return F.when(~F.coalesce(js_len(F.col(column)).between(least, most), F.lit(False)), "schema_violation")


def slug_suffixes(slug: Column) -> Column:
    """A slug and what follows each of its dashes: an item file clashes with any of these as a new slug."""
    parts = F.split(slug, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests in order of KB, category and turn, so that a group's come one after the other: what was accepted before counts for cap and slugs.

    A group's state is all that is held, whatever batches its rows come in.
    """
    group = active = last = filled = spent = None
    taken: set[str] = set()
    for batch in batches:
        codes, ids, fills, spends = [], [], [], []
        columns = [batch[n].to_pylist() for n in (*GROUP, "title_slug", "req_order", "active", "last_id")]
        for kb, category, slug, order, held, given in zip(*columns, strict=True):
            if group != (kb, category):
                group, active, last, taken, filled, spent = (kb, category), held, given, set(), None, None
            code = None
            if active >= CAP:
                code = "category_full"
            elif last >= MOST_IDS:
                code = "id_exhausted"
            elif slug in taken:
                code = "duplicate_slug"
            if code is None:
                active, last = active + 1, last + 1
                parts = slug.split("-")
                taken.update("-".join(parts[i:]) for i in range(len(parts)))
                if active == CAP:
                    filled = order
                if last == MOST_IDS:
                    spent = order
            codes.append(code)
            ids.append(None if code else last)
            fills.append(filled)
            spends.append(spent)
        numbers = [pa.array(v, pa.int64()) for v in (ids, fills, spends)]
        yield pa.RecordBatch.from_arrays([*[batch[g] for g in GROUP], batch["req_id"], pa.array(codes, pa.string()), *numbers], names=[*GROUP, "req_id", "code", "number", "filled_at", "spent_at"])


def created(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Verdicts on creates in their order: req_id, kb_path, category, item_id (null if refused), code (null if accepted).

    ``requests`` has req_id, req_order, kb_path, category, title_slug, n_paths (as
    given) and n_kept (inside the KB). A refused request takes no place, id or slug.
    A group that is full or out of ids stays so, so only as many requests as can
    matter are walked through in order; those after them get the state it ended in.
    """
    steps = Steps(items.sparkSession, "creates")
    state = items.groupBy(*GROUP).agg(F.count_if((F.col("status") == "active") & (F.col("location") == "active")).alias("active"), F.max(F.substring("item_id", 3, 3).cast("int")).alias("last_id"))
    held = items.select(*GROUP, F.explode(slug_suffixes(F.col("slug"))).alias("title_slug")).distinct().withColumn("clash", F.lit(True))
    known = requests.select("req_id", "req_order", *GROUP, "title_slug", ((F.col("n_paths") == 0) | (F.col("n_kept") > 0)).alias("region_ok"))
    known = known.join(state, GROUP, "left").join(held, [*GROUP, "title_slug"], "left")
    known = steps.store(known.withColumns({"active": F.coalesce("active", F.lit(0)), "last_id": F.coalesce("last_id", F.lit(0)), "clash": F.coalesce("clash", F.lit(False))}), "known")
    # An accepted slug of k words refuses at most the k suffixes of it, each once for each repetition; a slug's later
    # repetitions can never be accepted, so only its first request in the group is walked. Fewer than CAP accepted slugs
    # refuse at most as many others each as the longest has words: by then the group is full or out of ids. So only so many
    # of a group matter, and each task keeps no more of it before they meet.
    longest = known.agg(F.max(F.size(F.split("title_slug", "-")))).first()[0] or 0
    first = F.row_number().over(Window.partitionBy(*GROUP, "title_slug").orderBy("req_order"))
    turn = F.row_number().over(Window.partitionBy(*GROUP).orderBy("req_order"))
    walk = known.where("region_ok AND NOT clash").withColumn("first", first).where(F.col("first") == 1).withColumn("turn", turn).where(F.col("turn") <= (longest + 1) * CAP)
    kinds = ", ".join([*(f"{g} string" for g in GROUP), f"req_id {requests.schema['req_id'].dataType.simpleString()}", "code string, number bigint, filled_at bigint, spent_at bigint"])
    cloudpickle.register_pickle_by_value(sessionmill)
    walked = walk.select(*GROUP, "req_id", "req_order", "title_slug", "active", "last_id").repartition(*GROUP).sortWithinPartitions(*GROUP, "req_order")
    verdicts = steps.store(walked.mapInArrow(_in_order, kinds), "verdicts")
    ends = verdicts.groupBy(*GROUP).agg(F.min("filled_at").alias("filled_at"), F.min("spent_at").alias("spent_at"))
    out = known.join(verdicts.select("req_id", "code", "number", F.lit(True).alias("walked")), "req_id", "left").join(ends, GROUP, "left")
    full = (F.col("active") >= CAP) | F.coalesce(F.col("req_order") > F.col("filled_at"), F.lit(False))
    spent = (F.col("last_id") >= MOST_IDS) | F.coalesce(F.col("req_order") > F.col("spent_at"), F.lit(False))
    own = F.when(full, "category_full").when(~F.col("region_ok"), "region_violation").when(spent, "id_exhausted").when(F.col("walked").isNull(), "duplicate_slug").otherwise(F.col("code"))
    out = out.withColumn("code", own)
    return out.select("req_id", *GROUP, F.when(F.col("code").isNull(), F.concat(category_letter(F.col("category")), F.lit("-"), F.lpad(F.col("number").cast("string"), 3, "0"))).alias("item_id"), "code")


def create_verdicts(requests: DataFrame, items: DataFrame, registry: DataFrame) -> DataFrame:
    """Routed creates with their verdicts: the columns of ``requests`` as they would be stored, code, item_id, rerouted_from, paths_dropped.

    ``requests`` has req_id, req_order, kb_path, category, title_slug, summary, tags,
    paths, universality, severity, body; ``registry`` kb_path and kb_dir. A request
    whose paths all lie in one other KB goes there, and its relative paths are seen from
    there then; paths outside its KB's region are dropped, and severity is kept for
    anti-patterns only. Fields out of bounds are refused before anything else.
    Contents are judged where they lie and joined again at the end: what is routed and
    walked in order is keys and paths.
    """
    steps = Steps(items.sparkSession, "routes")
    dirs = registry.select("kb_path", "kb_dir")
    asked = requests.select("req_id", "req_order", *GROUP, "title_slug", "paths", written_verdict("universality").alias("bad")).join(dirs, "kb_path", "left")
    asked = steps.store(asked, "asked")
    found = path_owners(asked.withColumnRenamed("req_id", "item_key"), registry).withColumnRenamed("item_key", "req_id")
    # the one KB of all that lie in any
    kbs = F.array_distinct(F.filter(F.transform("owned", lambda o: o["owner"]), lambda k: k.isNotNull()))
    routed = asked.join(found, "req_id", "left").withColumn("target", F.when(F.size(kbs) == 1, F.get(kbs, F.lit(0))))
    routed = steps.store(routed.withColumn("rerouted_from", F.when(F.col("target") != F.col("kb_path"), F.col("kb_path"))).withColumn("kb_path", F.coalesce("target", "kb_path")), "routed")
    stayed = routed.where("rerouted_from IS NULL").select("req_id", *kept_of("owned", F.col("kb_path"), F.col("kb_dir")))
    moved = routed.where("rerouted_from IS NOT NULL").select(F.col("req_id").alias("item_key"), "kb_path", "paths").join(dirs, "kb_path")
    kept = stayed.unionByName(kept_paths(moved, registry).withColumnRenamed("item_key", "req_id"))
    sent = steps.store(routed.drop("owned", "target", "kb_dir").join(kept, "req_id"), "sent")
    sound = sent.where("bad IS NULL").select("req_id", "req_order", *GROUP, "title_slug", F.size("paths").alias("n_paths"), F.size("paths_kept").alias("n_kept"))
    verdicts = created(sound, items).select("req_id", "item_id", "code")
    told = sent.select("req_id", F.col("kb_path").alias("to_kb"), "paths_kept", "paths_dropped", "rerouted_from", "bad").join(verdicts, "req_id", "left").withColumn("code", F.coalesce("bad", "code"))
    out = requests.join(told, "req_id")
    stored = {"kb_path": F.col("to_kb"), "paths": F.col("paths_kept"), "severity": F.when(F.col("category") == "anti-pattern", F.col("severity"))}
    return out.select(*[stored.get(c, F.col(c)).alias(c) for c in requests.columns], "code", "item_id", "rerouted_from", "paths_dropped")


def with_created(items: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """The next snapshot: ``items`` and a row for each accepted create of ``create_verdicts``."""
    made = {"slug": F.col("title_slug"), "title": title_of_slug(F.col("title_slug")), "status": F.lit("active"), "created": now, "updated": now, "location": F.lit("active"), "archived_at": F.lit(None), "archive_reason": F.lit(None)}
    accepted = verdicts.where("code IS NULL")
    fresh = accepted.select(*[made.get(c, F.col(c) if c in verdicts.columns else F.lit(None)).cast(items.schema[c].dataType).alias(c) for c in items.columns])
    return items.unionByName(fresh)


def edit_verdicts(requests: DataFrame, items: DataFrame, archiving: bool = False) -> DataFrame:
    """``requests(req_id, req_order, kb_path, item_id, ...)`` with ``code``: null if accepted.

    target_not_found where no item has the id; where it is archived, by place or
    by status, target_archived for edits and already_archived for archiving, and
    so for all but the first request that archives an item.
    """
    rank = F.when(F.col("location") == "active", 0).otherwise(1)
    state = items.groupBy("kb_path", "item_id").agg(F.min_by(F.struct(F.col("location").alias("place"), F.col("status").alias("state")), rank).alias("held"))
    known = requests.join(state, ["kb_path", "item_id"], "left")
    gone = (F.col("held.place") == "archive") | (F.col("held.state") == "archived")
    if archiving:
        gone = gone | (F.row_number().over(Window.partitionBy("kb_path", "item_id").orderBy("req_order", "req_id")) > 1)
    return known.withColumn("code", F.when(F.col("held").isNull(), "target_not_found").when(gone, "already_archived" if archiving else "target_archived")).drop("held")


PATCH = ("new_body", "new_summary", "new_tags", "new_paths", "new_universality", "new_severity", "history_note")


def update_verdicts(requests: DataFrame, items: DataFrame, registry: DataFrame, superseding: bool = False) -> DataFrame:
    """Edits with code (null if accepted), paths_dropped, and new_paths as they would be stored.

    ``requests`` has req_id, req_order, kb_path, item_id, new_body, new_summary, new_tags,
    new_paths, new_universality, new_severity and, for superseding, history_note;
    ``registry`` kb_path and kb_dir. Codes, the first that holds: schema_violation or
    history_note_too_short; target_not_found, target_archived; region_violation where
    paths are given and none lies in the KB's directory.
    """
    known = edit_verdicts(requests.withColumn("bad", patch_verdict(superseding)), items).join(registry.select("kb_path", "kb_dir"), "kb_path", "left")
    kept, gone = kept_within(F.col("new_paths"), F.col("kb_dir")), dropped_outside(F.col("new_paths"), F.col("kb_dir"))
    region = F.when((F.size("new_paths") > 0) & (F.size(kept) == 0), "region_violation")
    known = known.withColumns({"code": F.coalesce("bad", "code", region), "paths_dropped": F.coalesce(gone, F.array().cast("array<string>")), "new_paths": kept})
    return known.drop("bad", "kb_dir")


def _edits(items: DataFrame, requests: DataFrame, registry: DataFrame, superseding: bool) -> DataFrame:
    """Items with the patch of all accepted requests for them: one row an item; the last value given of each field counts."""
    accepted = update_verdicts(requests, items, registry, superseding).where("code IS NULL")
    order = F.struct("req_order", "req_id")
    one = accepted.groupBy("kb_path", "item_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in PATCH if c in requests.columns]).withColumn("asked", F.lit(True))
    return items.join(one, ["kb_path", "item_id"], "left").withColumn("hit", F.coalesce(F.col("asked") & (F.col("location") == "active"), F.lit(False)))


def updated(items: DataFrame, requests: DataFrame, now: Column, registry: DataFrame) -> DataFrame:
    """The next snapshot after the requests of ``update_verdicts``.

    Each replaces the body; other null fields stay, and a severity is set for
    anti-patterns only. Refused requests change nothing. Several requests for an item give one row.
    """
    return _patched(_edits(items, requests, registry, False), items.columns, now, F.col("new_body"))


def superseded(items: DataFrame, requests: DataFrame, now: Column, registry: DataFrame) -> DataFrame:
    """As ``updated``, with ``history_note`` under the new body's history and the item active again."""
    entry = F.concat(now, F.lit(": superseded — "), F.col("history_note"))
    return _patched(_edits(items, requests, registry, True), items.columns, now, with_history(F.col("new_body"), entry), status="active")


def _patched(both: DataFrame, columns: list[str], now: Column, body: Column, status: str | None = None) -> DataFrame:
    hit = F.col("hit")
    new = {c: F.coalesce(f"new_{c}", c) for c in ("summary", "tags", "paths", "universality")}
    new |= {"body": body, "updated": now, "severity": F.when(F.col("category") == "anti-pattern", F.coalesce("new_severity", "severity")).otherwise(F.col("severity"))}
    if status:
        new["status"] = F.lit(status)
    return both.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns])


def archived(items: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """The next snapshot after ``requests(req_id, req_order, kb_path, item_id, reason)``: of several for an item the first counts."""
    accepted = edit_verdicts(requests, items, archiving=True).where("code IS NULL").select("kb_path", "item_id", "reason", F.lit(True).alias("asked"))
    both = items.join(accepted, ["kb_path", "item_id"], "left")
    hit = F.coalesce(F.col("asked") & (F.col("location") == "active"), F.lit(False))
    new = {"status": F.lit("archived"), "archived_at": now, "archive_reason": F.col("reason"), "location": F.lit("archive"), "updated": now}
    return both.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])


def freed_slots(before: DataFrame, after: DataFrame) -> DataFrame:
    """kb_path, category, remaining places and how many of them a change of snapshots freed."""
    held = active_counts(before).select("kb_path", "category", F.col("remaining").alias("had"))
    return active_counts(after).join(held, GROUP).select(*GROUP, "remaining", (F.col("remaining") - F.col("had")).alias("freed"))
