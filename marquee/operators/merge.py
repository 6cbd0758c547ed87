"""Merging batches into stored tables: insert-if-absent, upsert and column refresh.

Each function is a pure plan from the stored table and the batch to the new table (or the rows to
add); ``sources.tables.TableStore`` writes the outcome to a new version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.dedup import first_by_key, last_value


def absent_rows(target: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows to insert: of each key the first in the batch, if the target lacks the key."""
    columns = [c for c in batch.columns if c in target.columns]
    firsts = first_by_key(batch, key, order)
    return firsts.join(target.select(*key), list(key), "left_anti").select(columns)


def upsert(
    target: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str] = (), stamp: str | None = None,
    batch_keys: DataFrame | None = None,
) -> DataFrame:
    """The target with the batch's rows replacing or joining its own.

    With ``order`` the last row of a repeated key wins; without it the batch must be unique by key.
    ``stamp`` names a timestamp column set to the current time on the batch's rows. ``batch_keys`` gives
    the batch's keys where they are cheaper to have than the batch itself, which is else computed twice.
    """
    if order:
        newest = [F.col(c).desc_nulls_last() for c in order]
        batch = first_by_key(batch, key, newest)
    if stamp:
        batch = batch.withColumn(stamp, F.current_timestamp())
    batch = batch.select(target.columns)
    replaced = batch.select(*key) if batch_keys is None else batch_keys
    return target.join(replaced, list(key), "left_anti").select(target.columns).unionByName(batch)


def clean_feed(feed: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """A feed of text pairs: both trimmed, both non-empty, the last row of a key wins."""
    trimmed = feed.select(F.trim(key).alias(key), F.trim(column).alias(column), order)
    return last_value(trimmed.filter((F.length(key) > 0) & (F.length(column) > 0)), key, column, order)


def refresh_column(target: DataFrame, feed: DataFrame, key: str, column: str) -> DataFrame:
    """The target with ``column`` taken from the feed where it differs, plus ``change``.

    ``change`` is ``updated`` (a value was replaced), ``newly_added`` (it was null or empty) or null.
    The feed keys are text and unique; the target key is compared as text.
    """
    incoming = feed.select(F.col(key).alias("_feed_key"), F.col(column).alias("_incoming"))
    joined = target.join(incoming, target[key].cast("string") == F.col("_feed_key"), "left")
    old = F.col(column)
    differs = F.col("_incoming").isNotNull() & ~old.eqNullSafe(F.col("_incoming"))
    change = F.when(differs, F.when(_filled(old), F.lit("updated")).otherwise(F.lit("newly_added")))
    changed = joined.withColumn("change", change)
    return changed.withColumn(column, F.when(differs, F.col("_incoming")).otherwise(old)).select(
        *target.columns, "change"
    )


def _filled(column: Column) -> Column:
    return F.coalesce(column != "", F.lit(False))


def refresh_counts(refreshed: DataFrame) -> DataFrame:
    """(updated, newly_added, total) of a refreshed table."""
    updated, added = F.count_if(F.col("change") == "updated"), F.count_if(F.col("change") == "newly_added")
    return refreshed.agg(updated.alias("updated"), added.alias("newly_added"), (updated + added).alias("total"))
