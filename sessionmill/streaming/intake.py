"""Incremental intake: transcripts that are new or have grown are stamped into the ledger."""

from __future__ import annotations

from collections.abc import Callable

import sessionmill
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmill.functions.tables import Steps
from sessionmill.operators.ledger import ACTIONS
from sessionmill.sources.files import hashes_of, lines_of, opened
from sessionmill.sources.ledgers import LedgerStore
from sessionmill.sources.transcripts import is_message, parsed
from sessionmill.streaming.source import TranscriptSource


def unknown_files(files: DataFrame, store: LedgerStore) -> DataFrame:
    """``files`` without those that the ledger has by name and time; time 0 never matches."""
    held = store.known(files.select(F.col("session_stem").alias("session_id")))
    known = held.where("transcript_mtime_ms <> 0").select(F.col("session_id").alias("session_stem"), F.col("transcript_mtime_ms").alias("modification_ms"))
    return files.join(known, ["session_stem", "modification_ms"], "left_anti")


def sessions_read(files: DataFrame, read: DataFrame) -> DataFrame:
    """session_id, transcript_sha256, transcript_mtime_ms of the files of ``read`` whose messages name a session."""
    found = parsed(lines_of(read)).where(is_message() & F.col("session_id").isNotNull())
    ids = found.groupBy("path").agg(F.min_by("session_id", "line_no").alias("session_id"))
    return ids.join(hashes_of(read), "path").join(files.select("path", F.col("modification_ms").alias("transcript_mtime_ms")), "path").drop("path")


def stamp(files: DataFrame, store: LedgerStore, kb_path: str, now: str, source: str | None = None, batch_id: int | None = None) -> None:
    """Open the files that the ledger does not know, and stamp those versions of sessions that it lacks."""
    spark = files.sparkSession
    steps = Steps(spark, "intake")
    files = steps.store(files.dropDuplicates(["path"]), "files")
    fresh = steps.store(unknown_files(files, store), "fresh")
    seen = steps.store(sessions_read(fresh, opened(fresh)).withColumn("kb_path", F.lit(kb_path)), "seen")
    key = ["kb_path", "session_id", "transcript_sha256"]
    new = seen.join(store.known(seen), key, "left_anti").groupBy(*key).agg(F.max("transcript_mtime_ms").alias("transcript_mtime_ms"))
    nothing = F.lit(None).cast("string")
    stamps = new.select("*", F.lit("processed").alias("status"), nothing.alias("skipped_reason"), F.lit(0).alias("extracted_count"), F.array().cast(ACTIONS).alias("kb_actions"), nothing.alias("failure_reason"), F.lit(0).alias("stamp_order"))
    store.upsert(stamps, F.lit(now), source, batch_id)
    for name in ("files", "fresh", "seen"):
        steps.drop(name)


def intake(spark: SparkSession, root: str, store: LedgerStore, checkpoint: str, kb_path: str, now: Callable[[], str], settle_ms: int = 1000) -> StreamingQuery:
    """Stamps all transcripts below ``root`` that are new or have grown since the last run, and ends.

    Batches are in the ledger once, whichever of them is handed in again. Names that the
    ledger has with the same time are not opened, and only the ledger's buckets of the
    sessions at hand are read and written.
    """
    cloudpickle.register_pickle_by_value(sessionmill)
    spark.dataSource.register(TranscriptSource)
    files = spark.readStream.format("transcripts").option("settleMs", str(settle_ms)).load(root)
    batch = lambda df, batch_id: stamp(df, store, kb_path, now(), checkpoint, batch_id)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
