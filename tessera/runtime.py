"""Session helpers: the shared folder of the cluster, and tables written there to cut lineage.

Iterative plans grow without bound unless their state is cut loose between rounds.  State is written as
Parquet under the folder named by ``spark.checkpoint.dir``, which driver and executors share, so that a lost
executor costs a task and not the state.  The files carry their size, so later joins are planned from it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master without one, a new folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str = "state") -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stored:
    """A table in the shared folder: ``df`` reads it, ``drop()`` removes it."""

    def __init__(self, spark: SparkSession, df: DataFrame, what: str = "state"):
        self.spark, self.path = spark, new_path(spark, what)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def store(df: DataFrame, what: str = "state") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a plan without history."""
    return Stored(df.sparkSession, df, what).df
