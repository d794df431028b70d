"""Tables that cut the lineage of step-by-step jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster, whose executors would not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


class Steps:
    """Stored tables of one job; ``drop`` deletes those that no later step needs."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}", {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again; the table stored under ``name`` before is deleted."""
        path, before = f"{self.folder}/{name}-{uuid.uuid4().hex}", self.paths.get(name)
        df.write.parquet(path)
        self.paths[name] = path
        if before:
            self._delete(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if name in self.paths:
            self._delete(self.paths.pop(name))

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
