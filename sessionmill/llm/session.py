"""Session settings and storage that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import sessionmill
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches (texts can be long), functions that travel with the job, and a checkpoint folder where none is named.

    Executors need no copy of this package: its functions are sent by value.

    ``spark.checkpoint.dir`` of the session is used as it is; only where it is
    unset, in local mode, a temporary folder takes its place. Arrow batches of
    2000 rows hold for the whole session.
    """
    cloudpickle.register_pickle_by_value(sessionmill)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    Where none is named, local mode takes a temporary folder; on a cluster its
    executors would not share it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_written: list[str] = []


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, so later steps do not compute it again.

    The shuffle files of the job are deleted once the table is written, so steps add up no disk.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _written.append(path)
    return out


def replayable(df: DataFrame) -> DataFrame:
    """``df``, stored if it comes out of a shuffle, so that a task that runs again reads the same rows in the same order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, "input") if "Exchange" in plan else df


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _written.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables of which nothing that is still to be computed depends."""
    for df in frames:
        if (path := _paths.pop(df, None)) in _written:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table that this process stored: for callers that have written their results."""
    for path in list(_written):
        _delete(spark, path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
