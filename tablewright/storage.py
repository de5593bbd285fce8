"""Files on shared storage: scratch tables, and artefacts kept by a cache key."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a folder of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tablewright.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("tablewright.scratch.dir", base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) objects of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    system, where = hadoop_path(spark, path)
    system.delete(where, True)


class Scratch:
    """A folder for the tables of one call; it stays until the session ends, as results may read it lazily."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tablewright/{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it again, so that what follows starts at files that outlive any executor."""
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, name: str) -> None:
        remove(self.spark, self.at(name))

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            remove(self.spark, self.path)
