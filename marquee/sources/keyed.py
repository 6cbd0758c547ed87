"""Tables stored in buckets of their key, so that a merge rewrites the buckets it touches and leaves the others alone.

A row's bucket is the hash of its key's text, so keys of feeds that are text meet stored keys of any type. A merge reads the buckets of the batch, works
out their new rows by the plans of ``operators.merge``, keeps these in the shared folder (they are read from the files that they replace) and writes them with dynamic partition
overwrite: Spark replaces the folders of those buckets when the job commits. The commit is not atomic across buckets; a merge that breaks off in it can be
run again, as an upsert of the same batch gives the same rows. Choose the number of buckets so that one is a small part of a usual batch's work; a bucket is written
as ``files`` files by as many tasks. To the driver come the numbers of touched buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators import merge
from marquee.session import staged

BUCKET = "key_bucket"


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int
    files: int = 1

    @classmethod
    def create(cls, df: DataFrame, path: str, key: Sequence[str], buckets: int = 256, files: int = 1) -> KeyedTable:
        """Store a table; the path must not exist."""
        made = cls(df.sparkSession, path, df.schema, tuple(key), buckets, files)
        made._spread(df).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
        return made

    def _bucket(self, key: Sequence[str] | None = None) -> Column:
        texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key or self.key]
        return F.pmod(F.xxhash64(*texts), F.lit(self.buckets)).cast("int")

    def _spread(self, df: DataFrame) -> DataFrame:
        placed = df.withColumn(BUCKET, self._bucket())
        return placed.repartition(BUCKET, F.pmod(F.hash(*self.key), F.lit(self.files)))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def touched(self, batch: DataFrame, key: Sequence[str] | None = None) -> list[int]:
        """The buckets that hold, or would hold, the batch's keys."""
        return sorted(r[0] for r in batch.select(self._bucket(key).alias(BUCKET)).distinct().collect())

    def near(self, batch: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
        """The stored rows of the batch's buckets: all that share a key with it are among them. For checks before a load, too."""
        return self._stored().filter(F.col(BUCKET).isin(self.touched(batch, key))).drop(BUCKET)

    def _replace(self, rows: DataFrame) -> None:
        self._spread(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def upsert(self, batch: DataFrame, order: Sequence[str] = (), stamp: str | None = None) -> int:
        """Merge a batch as ``merge.upsert`` does; returns how many buckets were rewritten."""
        batch = staged(batch, "keyed-batch")
        buckets = self.touched(batch)
        if buckets:
            self._replace(staged(merge.upsert(self.near(batch), batch, list(self.key), order, stamp), "keyed-upsert"))
        return len(buckets)

    def refresh(self, feed: DataFrame, column: str) -> DataFrame:
        """Refresh a column from a feed of text keys as ``merge.refresh_column`` does and return its rows with ``change``; only buckets with a change are rewritten."""
        (key,) = self.key
        feed = staged(feed, "keyed-feed")
        found = staged(merge.refresh_column(self.near(feed, [key]), feed, key, column), "keyed-refresh")
        changed = self.touched(found.filter(F.col("change").isNotNull()))
        if changed:
            self._replace(found.filter(self._bucket().isin(changed)).drop("change"))
        return found
