"""Cutting lineage: tables in the folder of ``spark.checkpoint.dir``, which all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What one process stores lies in one folder, so that it can be deleted together.
RUN = uuid.uuid4().hex


def folder(spark: SparkSession) -> str:
    """The run's folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one is set, in local mode only: executors of a cluster share no local disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="hornbeam-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/hornbeam-{RUN}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has stored; call it when results that were built on it have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """A relation that grows by disjoint parts, each a Parquet table: adding one never rewrites the others."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema, self.paths = spark, schema, []

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Stores a part and returns it with its number of rows (read from footers)."""
        path = f"{folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        part = self.spark.read.schema(self.schema).parquet(path)
        n = part.count()
        if n:
            self.paths.append(path)
        return part, n

    @property
    def whole(self) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths)
