"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node of the edges (a, b).

    Each round every node points at its smallest neighbour and, by one jump, at that one's; edges then join what their ends
    point at, and those within one node go. Stars shrink in one round, chains to a fraction. Groups are reduced by ``min`` before the
    shuffle and joins have a side with unique keys, so a hub is no hot spot. Each round's tables are written to the shared folder.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "least")
        further = least.select(F.col("node").alias("up"), F.col("up").alias("root"))
        jumped = stored(least.join(further, "up").select("node", "root"), "jumped")
        if labels is None:
            labels = jumped
        else:
            step = jumped.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = stored(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = edges.join(jumped.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        ends = ends.join(jumped.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = stored(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
