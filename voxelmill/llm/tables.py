"""Reading the driver's tables, shared folders and small helpers of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most bytes of an Arrow batch in all actions of these operators.
BATCH_BYTES = "2m"
#: After so many tables of a run the driver collects its garbage: until then it keeps plans, broadcasts and shuffles of jobs that are over.
COLLECT_AFTER = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a folder under /tmp, for a local master only: elsewhere each machine has its own /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/voxelmill-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For actions inside: Arrow batches of BATCH_BYTES at most, so that long texts don't pile up in one; the session's own value comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that exists deleted when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as a Parquet table in a folder, read back: cuts lineage and outlives executors.  Without a folder it is one in the shared folder, for as long as the application runs."""
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    with small_batches(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if folder is None:
        gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one run of an operator, under one folder; clear() deletes them once the result, written elsewhere, needs them no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, shared_dir(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        table = written(df, f"{self.folder}/{self.tables}")
        if self.tables == 1:
            gone_at_exit(self.spark, self.folder)
        if self.tables % COLLECT_AFTER == 0:
            self.spark._jvm.System.gc()
        return table

    def counted(self, df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
        """The table, and how many rows it has, or how often ``what`` is true in them, as counted while it was written."""
        seen = Observation()
        table = self.written(df.observe(seen, F.count_if(F.lit(True) if what is None else what).alias("n")))
        return table, seen.get["n"]

    def clear(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
