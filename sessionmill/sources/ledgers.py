"""The ledger as hash buckets under a manifest, so that a change writes only the buckets that it touches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators.ledger import ACTIONS, upserted

COLUMNS = f"kb_path string, session_id string, transcript_sha256 string, transcript_mtime_ms bigint, status string, skipped_reason string, extracted_count int, kb_actions {ACTIONS}, failure_reason string, first_seen_at string, last_seen_at string"


class LedgerStore:
    """Versions of one ledger below ``root``.

    A session's rows lie in the bucket of its id's hash, each bucket in a folder that
    is never changed. A version is a manifest: which folder each bucket has, and the
    last batch of each source that is in it. A change writes new folders for the buckets
    that it touches, then a manifest, and points to that last; so a reader sees one
    version or the next, and a job that dies in between leaves the old one. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _put(self, name: str, text: str) -> None:
        store, path = self._path(name)
        out = store.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, name: str) -> str | None:
        store, path = self._path(name)
        if not store.exists(path):
            return None
        reader = store.open(path)
        try:
            return bytes(reader.readAllBytes()).decode()
        finally:
            reader.close()

    def manifest(self) -> dict:
        """version, buckets (how many), folders (by bucket), applied (last batch by source)."""
        # the newest pointer counts; an older one stays until a newer one is complete
        store, path = self._path("")
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        done = [int(n.removeprefix("current-")) for n in names if n.startswith("current-") and n.removeprefix("current-").isdigit()]
        if not done:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "applied": {}}
        return json.loads(self._get(f"manifest-{max(done)}.json"))

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(manifest["buckets"])).cast("int")

    def read(self, only: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        manifest = manifest or self.manifest()
        folders = [f"{self.root}/{f}" for b, f in manifest["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(COLUMNS).parquet(*folders) if folders else self.spark.createDataFrame([], COLUMNS)

    def known(self, sessions: DataFrame) -> DataFrame:
        """The rows of the buckets that ``sessions(session_id)`` fall into; only these are opened."""
        manifest = self.manifest()
        return self.read([r[0] for r in sessions.select(self._bucket(manifest)).distinct().collect()], manifest)

    def upsert(self, stamps: DataFrame, now: Column, source: str | None = None, batch_id: int | None = None) -> dict:
        """The next version with ``stamps`` (as for ``upserted``) in it, and its manifest.

        A batch of a source that is in the ledger already changes nothing, nor does an
        empty one: so a stream may hand in a batch again.
        """
        manifest = self.manifest()
        if source is not None and manifest["applied"].get(source, -1) >= batch_id:
            return manifest
        bucket = self._bucket(manifest)
        # at most as many as there are buckets
        touched = [r[0] for r in stamps.select(bucket).distinct().collect()]
        applied = manifest["applied"] | ({source: batch_id} if source is not None else {})
        if not touched and applied == manifest["applied"]:
            return manifest
        folders = dict(manifest["folders"])
        if touched:
            made = f"data/{uuid.uuid4().hex}"
            after = upserted(self.read(touched, manifest), stamps, now).withColumn("bucket", bucket)
            after.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{made}")
            folders |= {str(b): f"{made}/bucket={b}" for b in touched}
        manifest = {"version": manifest["version"] + 1, "buckets": manifest["buckets"], "folders": folders, "applied": applied}
        self._put(f"manifest-{manifest['version']}.json", json.dumps(manifest))
        self._put(f"current-{manifest['version']}", "")
        return manifest

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests before the last ``keep``, and folders that none of these names; how many were deleted."""
        last = self.manifest()["version"]
        kept, deleted = set(), 0
        for version in range(max(1, last - keep + 1), last + 1):
            text = self._get(f"manifest-{version}.json")
            kept |= set(json.loads(text)["folders"].values()) if text else set()
        store, data = self._path("data")
        for job in store.listStatus(data) if store.exists(data) else []:
            for part in store.listStatus(job.getPath()):
                name = f"data/{job.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in kept:
                    deleted += store.delete(part.getPath(), True)
        for version in range(max(1, last - keep), 0, -1):
            if self._get(f"manifest-{version}.json") is None:
                break
            for name in (f"current-{version}", f"manifest-{version}.json"):
                store, path = self._path(name)
                store.delete(path, True)
        return deleted
