"""Staged tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a local folder only where none is set and the master is local, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def not_broadcast(df: DataFrame) -> DataFrame:
    """For staged tables of keys and numbers: their files compress so well that Spark, judging by file size, would broadcast
    millions of their rows, which the driver has to collect first."""
    return df.hint("merge")


class Staging:
    """Writes tables and reads them again, which cuts lineage; a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        """``name`` tells people whose tables these are; the folder is deleted when the process ends."""
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, label: str) -> str:
        return f"{self.base}/{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, label: str | None = None) -> None:
        with contextlib.suppress(Exception):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(label) if label else self.base)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
