"""Files by name: given paths are opened where Spark runs the task, whichever store they are in, and named files are written.

Spark's readers take folders and open all that is below them. Here a table of paths
decides: a join that drops a row saves opening that file. Stores are those that
pyarrow knows (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
import sessionmill
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionmill.functions.tables import Steps

BATCH_LINES, BATCH_CHARS, CHUNK = 2_000, 4 << 20, 1 << 20
TASK_BYTES = 128 << 20
#: Tasks for each core that folders are dealt to.
DEALT = 4
READ = "path string, line_no long, raw string, transcript_sha256 string"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it (file:/a, s3://b/c, /a), and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def cut_lines(chunks: Iterator[bytes], digest) -> Iterator[tuple[int, str]]:
    """(line_no from 1, line) of the lines of a file that are not blank, as its chunks come; ``digest`` takes in all bytes. A line, not a file, is held at once."""
    held, line_no = [], 0
    for chunk in chunks:
        digest.update(chunk)
        *whole, rest = chunk.split(b"\n")
        for part in whole:
            line_no += 1
            line = b"".join([*held, part]).decode("utf-8", "replace")
            held = []
            if line.strip():
                yield line_no, line
        held.append(rest)
    line = b"".join(held).decode("utf-8", "replace")
    if line.strip():
        yield line_no + 1, line


def _chunks(path: str) -> Iterator[bytes]:
    store, place = store_of(path)
    with store.open_input_stream(place, buffer_size=CHUNK) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in READ.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    for given in batches:
        for path in given["path"].to_pylist():
            digest, rows, chars = hashlib.sha256(), [], 0
            for line_no, line in cut_lines(_chunks(path), digest):
                rows.append((path, line_no, line, None))
                chars += len(line)
                if len(rows) >= BATCH_LINES or chars >= BATCH_CHARS:
                    yield batch(rows)
                    rows, chars = [], 0
            yield batch([*rows, (path, None, None, digest.hexdigest())])


def opened(files: DataFrame) -> DataFrame:
    """The lines that are not blank, and the SHA-256, of ``files(path, length)``: path, line_no, raw, transcript_sha256.

    Every file is read once, as a stream, and nothing else is opened. Its hash is
    known at its end, so it has a row of its own, the only one with transcript_sha256
    and without line_no. An empty file has that row alone; bytes that are no UTF-8 become
    the replacement character. Tasks get files of about 128 MB together.
    """
    cloudpickle.register_pickle_by_value(sessionmill)
    total = files.agg(F.sum("length")).first()[0] or 0
    return files.select("path").repartition(max(1, -(-total // TASK_BYTES), min(files.sparkSession.sparkContext.defaultParallelism, total // CHUNK + 1)), "path").mapInArrow(_opened, READ)


def lines_of(read: DataFrame) -> DataFrame:
    return read.where("line_no IS NOT NULL").select("path", "line_no", "raw")


def hashes_of(read: DataFrame) -> DataFrame:
    return read.where("line_no IS NULL").select("path", "transcript_sha256")


def numbered_lines(read: DataFrame) -> DataFrame:
    """path, line_no, raw of text files of any size, whichever way Spark splits them.

    ``read`` is what spark.read.text gives with lineSep of a line feed. A split's rows
    come one after the other, so a row's place in its split is its id less the least
    of the split; the lines of the file's splits before it, a short list, are added.
    """
    named = read.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = named.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = named.join(splits.select("path", "start", "first", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["path", "start"])
    return placed.where(F.regexp_replace("value", r"\s+", "") != "").select("path", (F.col("ahead") + F.col("id") - F.col("first") + 1).alias("line_no"), F.col("value").alias("raw"))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
    for given in batches:
        for folder in given["path"].to_pylist():
            store, place = store_of(folder)
            found = store.get_file_info(pafs.FileSelector(place, allow_not_found=True))
            # the address of a place as its folder was given
            head = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
            rows = [(head + i.path, folder, i.type == pafs.FileType.Directory, (i.mtime_ns or 0) // 1_000_000, i.size or 0) for i in found]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "dir", "is_dir", "modification_ms", "length"])


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, dir, modification_ms, length of every file below ``root``, hidden and empty ones too. Nothing is opened.

    A job for each level of folders, each of them listed where a task runs, so that no
    process holds the whole tree.
    """
    cloudpickle.register_pickle_by_value(sessionmill)
    steps, level, levels = Steps(spark, "walk"), spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), []
    while True:
        found = level.select("path").mapInArrow(_entries, "path string, dir string, is_dir boolean, modification_ms long, length long")
        found = steps.store(found, f"level-{len(levels)}")
        levels.append(found.where("NOT is_dir"))
        level = found.where("is_dir")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels).drop("is_dir")
        level = level.repartition(spark.sparkContext.defaultParallelism, "path")


def _whole(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    named = re.compile(pattern)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["folder", "file_name", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows, size = [], 0
            for folder in given["folder"].to_pylist():
                store, place = store_of(folder)
                for info in store.get_file_info(pafs.FileSelector(place, allow_not_found=True)):
                    if info.type == pafs.FileType.File and named.fullmatch(info.base_name):
                        with store.open_input_stream(info.path) as stream:
                            rows.append((folder, info.base_name, stream.read().decode("utf-8", "replace")))
                        size += info.size or 0
                        if len(rows) >= BATCH_LINES or size >= BATCH_CHARS:
                            yield batch(rows)
                            rows, size = [], 0
            if rows:
                yield batch(rows)

    return run


def whole_files(folders: DataFrame, pattern: str) -> DataFrame:
    """folder, file_name, text of the files of ``folders(folder)`` whose whole name fits ``pattern``; folders that are not there have none.

    For small files. Folders are listed where the tasks run, hidden ones too, which
    Spark's readers leave out. Their names are few bytes whatever lies in them, so they
    are dealt to a set number of tasks, which Spark does not merge into one.
    """
    cloudpickle.register_pickle_by_value(sessionmill)
    tasks = DEALT * folders.sparkSession.sparkContext.defaultParallelism
    return folders.select("folder").repartition(tasks, "folder").mapInArrow(_whole(pattern), "folder string, file_name string, text string")


def _written(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            sizes = []
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                data = content.encode("utf-8", "surrogatepass")
                place = f"{base.rstrip('/')}/{name.lstrip('/')}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                # whoever looks at the name sees the whole file or none, also if a task runs twice
                with store.open_output_stream(f"{place}.writing") as out:
                    out.write(data)
                store.move(f"{place}.writing", place)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(sizes, pa.int64())], names=["name", "length"])

    return run


def write_named(files: DataFrame, root: str) -> int:
    """Write ``files(name, content)`` below ``root``, one file each under its own name; how many were written.

    Names are relative and distinct. A file is written beside its place and moved there.
    """
    cloudpickle.register_pickle_by_value(sessionmill)
    return files.select("name", "content").mapInArrow(_written(root), "name string, length long").count()
