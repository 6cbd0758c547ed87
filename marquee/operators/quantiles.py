"""Exact interpolated quantiles of columns of any size.

The built-in exact percentile gathers every distinct value in one task. Here values are counted first, sorted into ranges by column
and value, and summed up within each range; one small row per column and range gives what lies before it. Every wanted rank is then found
where it stands. The driver sees nothing but the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import staged

ACCURACY = 10_000


def _long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    return df.select(F.inline(F.array(*cells))).filter(F.col("v").isNotNull())


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(column, p, quantile) with linear interpolation between the two neighbouring ranks; columns without values are left out."""
    return quantiles_of_counts(_long_form(df, columns).groupBy("column", "v").agg(F.count("*").alias("m")), probs)


def quantiles_of_counts(counted: DataFrame, probs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The same from counted values: column, v and its number of rows m."""
    ranges = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_values = counted.repartitionByRange(ranges, "column", "v")
    placed = staged(sorted_values.withColumn("part", F.spark_partition_id()), "quantiles")
    # One row per column and range: how many values lie before it, and how many there are.
    totals = placed.groupBy("column", "part").agg(F.sum("m").alias("size"))
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "column", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("column")).alias("n")
    )
    upto = Window.partitionBy("column", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("upto", F.sum("m").over(upto)).join(totals, ["column", "part"]).withColumn("upto", F.col("before") + F.col("upto"))

    def held(rank: Column) -> Column:
        """Whether the value stands at a rank (from 0)."""
        return (rank >= F.col("upto") - F.col("m")) & (rank < F.col("upto"))

    picks = []
    for p in probs:
        rank = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(rank), F.least(F.floor(rank) + 1, F.col("n") - 1)
        picks += [(p, F.min(F.when(held(low), F.col("v"))), F.min(F.when(held(high), F.col("v"))))]
    found = ranked.groupBy("column").agg(
        F.max("n").alias("n"), F.array(*[F.struct(F.lit(float(p)).alias("p"), low.alias("low"), high.alias("high")) for p, low, high in picks]).alias("_picked")
    )
    found = found.select("column", "n", F.inline("_picked"))
    part = F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1))
    step = F.when(part > 0, (F.col("high") - F.col("low")) * part).otherwise(F.lit(0.0))
    return found.select("column", "p", (F.col("low") + step).alias("quantile"))


def approximate_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The same shape from one mergeable sketch per column; rank error at most 1/10000."""
    picked = _long_form(df, columns).groupBy("column").agg(F.percentile_approx("v", list(probs), ACCURACY).alias("q"))
    return picked.select("column", F.explode(F.map_from_arrays(F.array(*map(F.lit, probs)), "q")).alias("p", "quantile"))
