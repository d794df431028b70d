"""The ledger of processed sessions, and the scan for sessions that still need work.

``ledger`` has kb_path, session_id, transcript_sha256, transcript_mtime_ms,
first_seen_at, last_seen_at, status, skipped_reason, extracted_count, kb_actions
(array of struct(kb, actions)), failure_reason. ``now`` is always given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a mark, and the reasons for skipping.
STATUSES = ("processed", "skipped", "failed")
SKIP_REASONS = ("multi-kb-session", "trivial", "low-value", "transcript-corrupt", "other")
ACTIONS = "array<struct<kb:string,actions:array<string>>>"
KEY = ["kb_path", "session_id", "transcript_sha256"]
PATCHED = ["transcript_mtime_ms", "status", "skipped_reason", "extracted_count", "kb_actions", "failure_reason"]


def unchanged(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that a ledger knows by name and modification time, so that they need not be read; time 0 never matches."""
    known = ledger.where("transcript_mtime_ms <> 0").select(F.col("session_id").alias("session_stem"), F.col("transcript_mtime_ms").alias("modification_ms")).distinct()
    return files.join(known, ["session_stem", "modification_ms"], "left_semi")


def recorded(sessions: DataFrame, chain: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sessions whose id and hash are in any ledger of their directory's chain."""
    keys = ledger.select(*KEY).distinct()
    found = sessions.select("session_id", "transcript_sha256", "cwd").join(chain.select("cwd", "kb_path"), "cwd").join(keys, KEY, "left_semi")
    return found.select("session_id", "transcript_sha256").distinct()


def outcomes(sessions: DataFrame, chain: DataFrame, ledger: DataFrame, scope: DataFrame, since: str | None = None) -> DataFrame:
    """``sessions`` with ``outcome``, first that holds: already (by time), unparseable, out_of_scope, no_kb, already, before_since, collectible.

    ``sessions`` has session_id, session_stem, modification_ms, transcript_sha256,
    cwd (null if unparseable), first_seen_at; ``scope`` has the cwds in scope.
    """
    quick = unchanged(sessions, ledger).select("session_stem", "modification_ms").distinct().withColumn("quick", F.lit(True))
    known = recorded(sessions, chain, ledger).withColumn("known", F.lit(True))
    kbs = chain.select("cwd").distinct().withColumn("has_kb", F.lit(True))
    flagged = sessions.join(quick, ["session_stem", "modification_ms"], "left").join(known, ["session_id", "transcript_sha256"], "left").join(kbs, "cwd", "left").join(scope.select("cwd").distinct().withColumn("scoped", F.lit(True)), "cwd", "left")
    late = F.lit(False) if since is None else F.try_to_timestamp("first_seen_at") < F.to_timestamp(F.lit(since))
    outcome = (
        F.when(F.col("quick"), "already")
        .when(F.col("cwd").isNull(), "unparseable")
        .when(F.col("scoped").isNull(), "out_of_scope")
        .when(F.col("has_kb").isNull(), "no_kb")
        .when(F.col("known"), "already")
        .when(late, "before_since")
        .otherwise("collectible")
    )
    return flagged.withColumn("outcome", outcome).drop("quick", "known", "has_kb", "scoped")


def counters(found: DataFrame) -> DataFrame:
    """outcome, sessions; what cannot be parsed and what is too old is not counted."""
    return found.where(~F.col("outcome").isin("unparseable", "before_since")).groupBy("outcome").agg(F.count("*").alias("sessions"))


def newest(found: DataFrame, limit: int = 20) -> DataFrame:
    """The newest collectible sessions, by the order of their time as text, then by path."""
    return found.where("outcome = 'collectible'").orderBy(F.desc("first_seen_at"), "path").limit(max(1, min(limit, 50)))


def mark_verdict() -> Column:
    """Why a mark is refused, or null."""
    outside = F.size(F.array_except(F.transform("kb_actions", lambda a: a["kb"]), F.col("affected_kbs"))) > 0
    return (
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "schema_violation")
        .when((F.col("status") == "skipped") & ~F.coalesce(F.col("skipped_reason").isin(*SKIP_REASONS), F.lit(False)), "skipped_without_reason")
        .when((F.col("status") == "failed") & (F.coalesce(F.col("failure_reason"), F.lit("")) == ""), "failed_without_reason")
        .when(F.length("failure_reason") > 500, "schema_violation")
        .when(outside, "action_outside_affected")
    )


def fanned_out(marks: DataFrame) -> DataFrame:
    """A row for each affected KB, with that KB's actions only; a KB without any has an empty list."""
    spread = marks.withColumn("kb_path", F.explode("affected_kbs"))
    return spread.withColumn("kb_actions", F.filter("kb_actions", lambda a: a["kb"] == F.col("kb_path"))).drop("affected_kbs")


def upserted(ledger: DataFrame, stamps: DataFrame, now: Column) -> DataFrame:
    """The ledger's next snapshot.

    ``stamps`` has kb_path, session_id, transcript_sha256, the patched columns and
    stamp_order; of several stamps of a key the last counts. A known key keeps its
    first_seen_at; a new one is added, and other versions of its session stay.
    """
    last = stamps.groupBy(*KEY).agg(F.max_by(F.struct(*PATCHED), F.col("stamp_order")).alias("new")).withColumn("stamped", F.lit(True))
    both = ledger.join(last, KEY, "full")
    patched = [F.when(F.col("stamped"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in PATCHED]
    seen = [F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(F.col("stamped"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at")]
    return both.select(*KEY, *patched, *seen)


def reconciled(targets: DataFrame, ledger: DataFrame, chain: DataFrame) -> DataFrame:
    """What became of each target: session_id, status, kb_path; the first KB of the chain that has it counts, none is deferred.

    ``chain(kb_path, position)``.
    """
    stamps = ledger.select("session_id", "kb_path", "status", "last_seen_at").join(chain.select("kb_path", "position"), "kb_path")
    first = stamps.groupBy("session_id").agg(F.min_by(F.struct("status", "kb_path"), F.struct("position", "kb_path", "status")).alias("first"))
    return targets.select("session_id").distinct().join(first, "session_id", "left").select("session_id", F.coalesce("first.status", F.lit("deferred")).alias("status"), "first.kb_path")


def breakdown(found: DataFrame) -> DataFrame:
    """status, sessions, and the ids of those deferred, in order."""
    deferred = F.array_sort(F.collect_list(F.when(F.col("status") == "deferred", F.col("session_id"))))
    return found.groupBy("status").agg(F.count("*").alias("sessions"), deferred.alias("deferred"))


