"""Duplicate removal and first/last-seen rules.

Row order is an explicit column (or several). Every rule reduces each key on the map side before the
shuffle: ``row_number() <= 1`` is planned as a group limit, and the aggregates combine partially. So
a key holding a third of all rows sends one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def drop_full_duplicates(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per distinct content. ``order`` columns are not content; the smallest order survives."""
    content = [c for c in df.columns if c not in order]
    if not order:
        return df.dropDuplicates()
    if len(order) == 1 and isinstance(df.schema[order[0]].dataType, NumericType):
        # A fixed-width buffer lets Spark aggregate by hash, without sorting whole contents.
        kept = df.groupBy(*content).agg(F.min(order[0]).alias(order[0]))
        return kept.select(df.columns)
    first = F.min(F.struct(*order)).alias("_first")
    kept = df.groupBy(*content).agg(first)
    return kept.select(*[F.col(f"_first.{c}").alias(c) if c in order else F.col(c) for c in df.columns])


def first_by_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str | Column], keep_null_keys: bool = False
) -> DataFrame:
    """The first row of each key in the given order, which must be total.

    Null keys count as equal, so of all rows without a key only the first survives, unless
    ``keep_null_keys``.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    if not keep_null_keys:
        return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    absent = F.lit(False)
    for c in key:
        absent = absent | F.col(c).isNull()
    kept = df.filter(~absent).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return kept.unionByName(df.filter(absent))


def first_values(df: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``key`` with the values seen first; the rule for canonical entities."""
    return first_by_key(df.select(key, *values, *[c for c in order if c not in (key, *values)]), [key], order).select(
        key, *values
    )


def last_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key`` with the value seen last; a later row overwrites an earlier one."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
