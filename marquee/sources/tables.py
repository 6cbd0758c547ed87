"""Stored tables as Parquet folders with numbered versions.

A table is its newest version and that version's added segments, each a folder of its own that becomes visible when Spark commits it (its
``_SUCCESS`` marker). A job never writes into what is read, additions appear whole or not at all, and a job that dies leaves an unmarked folder
whose number is not used again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a schema; NaN becomes null and an empty string stays empty."""
    columns = []
    for f in schema.fields:
        value = F.col(f.name)
        if isinstance(df.schema[f.name].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(columns)


class TableStore:
    """Named tables below one root path on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, name: str) -> list[tuple[int, int, bool]]:
        """(version, segment, committed) of every folder, also of failed writes; segment 0 is the version itself."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            version, _, segment = status.getPath().getName().removeprefix("v").partition("-")
            found.append((int(version), int(segment or 0), fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))))
        return sorted(found)

    def _path(self, name: str, version: int, segment: int) -> str:
        return f"{self.root}/{name}/v{version:06d}" + (f"-{segment:06d}" if segment else "")

    def _current(self, name: str) -> list[tuple[int, int]]:
        """Version and segments that make up the table."""
        done = [(v, s) for v, s, committed in self._folders(name) if committed]
        version = max((v for v, s in done if s == 0), default=None)
        return [(v, s) for v, s in done if v == version]

    def exists(self, name: str) -> bool:
        return bool(self._current(name))

    def paths(self, name: str) -> list[str]:
        """The folders of the newest version and its segments."""
        current = self._current(name)
        if not current:
            raise FileNotFoundError(f"no stored table {name} below {self.root}")
        return [self._path(name, *c) for c in current]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self.paths(name))

    def replace(self, name: str, df: DataFrame, sort_by: Sequence[str] = ()) -> int:
        """Write a new version and return its row count; ``sort_by`` clusters rows inside each file
        so that readers can skip row groups by their minimum and maximum."""
        version = max((v for v, _, _ in self._folders(name)), default=0) + 1
        return self._write(df.sortWithinPartitions(*sort_by) if sort_by else df, self._path(name, version, 0))

    def append(self, name: str, df: DataFrame) -> int:
        """Add rows to the current version (the first one if there is none) and return how many."""
        current = self._current(name)
        if not current:
            return self.replace(name, df)
        version = current[0][0]
        segment = max(s for v, s, _ in self._folders(name) if v == version) + 1
        return self._write(df, self._path(name, version, segment))

    @staticmethod
    def _write(df: DataFrame, path: str) -> int:
        seen = Observation()
        df.observe(seen, F.count("*").alias("rows")).write.mode("errorifexists").parquet(path)
        return seen.get["rows"]
