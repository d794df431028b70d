"""A stream of the transcripts that are new or have grown."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sessionmill.sources.files import store_of

FILES_A_TASK = 10_000


def listed(root: str, after: int, until: int) -> Iterator[tuple[str, int, int]]:
    """(path, modification_ms, length) of the transcripts below ``root`` that were changed after ``after`` and up to ``until``."""
    store, base = store_of(root)
    prefix = root[: len(root) - len(base)] if root.endswith(base) else ""
    for info in store.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True)):
        if info.type == pafs.FileType.File and info.base_name.endswith(".jsonl") and not info.base_name.endswith("-summary.jsonl"):
            changed = info.mtime_ns // 1_000_000
            if after < changed <= until:
                yield prefix + info.path, changed, info.size


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(len(files))
        self.files = files


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.settle_ms = options["path"], int(options.get("settlems", "1000"))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int(time.time() * 1000) - self.settle_ms - 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = sorted(listed(self.root, start["until"], end["until"]))
        return [_Part(found[i : i + FILES_A_TASK]) for i in range(0, len(found), FILES_A_TASK)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, changed, length in partition.files:
            yield path, path.rsplit("/", 1)[-1].removesuffix(".jsonl"), changed, length


class TranscriptSource(DataSource):
    """Names, times and sizes of transcripts: path, session_stem, modification_ms, length. Nothing is opened.

    The offset is a time: a batch has the files whose last change lies between two
    offsets, so a file that grows comes again under its old name, however many files
    there are, and the checkpoint keeps one number. The newest ``settleMs`` (1000) are
    left for the next batch, as other files may still get the same time. Files that are
    moved in with an old time are found by the batch scan alone.
    """

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "path string, session_stem string, modification_ms long, length long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
