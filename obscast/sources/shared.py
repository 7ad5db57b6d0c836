"""The folder that driver and executors share, and tables that live in it for a while."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`, or the checkpoint folder set in the session.

    Only a session in local mode gets a temporary folder where neither is set; on a cluster
    tasks could not read it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` written as Parquet to the shared folder and read again, so that its plan ends there."""
    return _written(df, shared_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this job's own making, on whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one job, written to the shared folder and removed together.

    Tables read from it must not be used after `close`; a job that fails leaves its folder
    behind for whoever cleans the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._made = spark, shared_path(spark, name), 0

    def cut(self, df: DataFrame) -> DataFrame:
        self._made += 1
        return _written(df, f"{self.path}/{self._made:04d}")

    def drop(self, df: DataFrame) -> None:
        """Removes a table of `cut` before the others."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(self.spark, path)

    def close(self) -> None:
        remove(self.spark, self.path)
