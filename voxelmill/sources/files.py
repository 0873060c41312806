"""Writing whole files from rows: pieces of files, and members of ZIP archives.

    register(spark)
    pieces.transform(files.by_file("name")).write.format("pieces").mode("append").save("/out")

A file is one task's work, piece by piece, so a task holds a piece at a time; it
appears under its name only when it is whole.  The folder is one that all machines
have mounted.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def by_file(name: str, *order: str) -> Callable[[DataFrame], DataFrame]:
    """Deals rows out by file, each file's in order."""
    return lambda rows: rows.repartition(name).sortWithinPartitions(name, *order)


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class PiecesWriter(DataSourceArrowWriter):
    """Rows (name, piece, content), a file's together and in order: its contents one after the other."""

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")

    def open(self, path: str):
        return open(path, "wb")

    def add(self, handle, row: dict) -> None:
        handle.write(row["content"])

    def write(self, batches):
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        attempt, done, now, handle = TaskContext.get().taskAttemptId(), [], None, None

        def close() -> None:
            if handle is not None:
                handle.close()
                target = os.path.join(self.folder, now)
                os.replace(f"{target}.{attempt}.tmp", target)
                done.append(now)

        for batch in batches:
            for row in batch.to_pylist():
                key = row[self.key]
                if key != now:
                    close()
                    now, handle = key, self.open(os.path.join(self.folder, f"{key}.{attempt}.tmp"))
                self.add(handle, row)
        close()
        return Written(tuple(done))

    key = "name"


class ZipWriter(PiecesWriter):
    """Rows (archive, name, content), an archive's together: its members."""

    key = "archive"

    def open(self, path: str):
        return zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)

    def add(self, handle, row: dict) -> None:
        handle.writestr(zipfile.ZipInfo(row["name"]), row["content"], zipfile.ZIP_DEFLATED)


class PiecesSource(DataSource):
    @classmethod
    def name(cls):
        return "pieces"

    def schema(self):
        return "name string, piece long, content binary"

    def writer(self, schema, overwrite):
        return PiecesWriter(dict(self.options))


class ZipSource(DataSource):
    @classmethod
    def name(cls):
        return "zips"

    def schema(self):
        return "archive string, name string, content binary"

    def writer(self, schema, overwrite):
        return ZipWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PiecesSource)
    spark.dataSource.register(ZipSource)
