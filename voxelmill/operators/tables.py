"""Tables in the shared folder, by which loops and repeated reads cut their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is named, one under /tmp, for a local master only: elsewhere each machine has its own /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (folder or "file:///tmp/checkpoints").rstrip("/")


class Tables:
    """Tables of one run of an operator, by name, in a folder of its own.

    A table is written once and read back, so a later plan knows nothing of the
    one that made it and any executor can read it.  (A checkpoint carries the old
    plan's properties along; in a loop the time to plan then grows by the round.)
    A name's former version goes once the new one is written; what is left goes
    when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/voxelmill-{uuid.uuid4().hex}"
        self.versions: dict[str, int] = {}
        where = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}-{self.versions[name]}")

    def cut(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table; drops the former table of that name."""
        former = self._path(name) if name in self.versions else None
        self.versions[name] = self.versions.get(name, 0) + 1
        where = self._path(name)
        df.write.parquet(where.toString())
        if former is None:
            self.files.deleteOnExit(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder))
        else:
            self.files.delete(former, True)
        return self.spark.read.schema(df.schema).parquet(where.toString())

    def drop(self, *names: str) -> None:
        for name in names:
            self.files.delete(self._path(name), True)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later steps start from it, on any executor."""
    return Tables(df.sparkSession).cut("table", df)
