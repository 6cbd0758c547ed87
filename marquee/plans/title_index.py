"""A stored inverted index of titles: a search reads the posting lists of its own pieces and the titles they lead to.

Both compared forms of a title are cut into pieces of three characters, one from every character on (the last two run over the end, so that every text of one character or more
has pieces). A posting row holds the ids of one part of the titles that contain a piece; rows are stored by the hash of the piece's first two characters, so a fragment of two
characters finds all pieces that begin with it in one bucket. A pattern's literal fragments give its keys; the numbers of titles are read first (without the ids), the ``KEYS``
rarest lists are intersected, and the candidates, read from the parts of the titles that hold them, are verified by the comparison that a search without an
index makes, wildcards included. A pattern without a fragment of two characters has no keys and reads all titles.

To the driver come the sizes of at most 100 lists and the numbers of the parts that hold candidates (at most ``parts``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import like_fragments, like_text, search_form
from marquee.plans.search import relevance, with_search_forms
from marquee.session import dealt_out, fresh_path

PIECE = 3
LEAST = 2
END = "\x00"
KEYS = 3
BUCKETS = 64
PARTS = 64


def keys(source: str) -> list[str]:
    """Pieces that every matching text holds: whole ones, and beginnings of pieces for fragments of two characters."""
    found = []
    for fragment in like_fragments(f"%{source}%"):  # as it is compared: an escape at its end escapes the wildcard behind it
        if len(fragment) >= PIECE:
            found += [fragment[i: i + PIECE] for i in range(len(fragment) - PIECE + 1)]
        elif len(fragment) == LEAST:
            found.append(fragment)
    return list(dict.fromkeys(found))


def pieces(form: Column) -> Column:
    """The distinct pieces of a text."""
    padded = F.concat(form, F.lit(END * (PIECE - 1)))
    starts = F.when(F.length(form) > 0, F.sequence(F.lit(1), F.greatest(F.length(form), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(PIECE)))), F.array().cast("array<string>"))


def _bucket(piece: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.substring(piece, F.lit(1), F.lit(LEAST)), "utf-8")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class TitleIndex:
    """postings: bucket, piece, part, titles (how many) and ids. titles: the movies with both forms, by part."""

    postings: DataFrame
    titles: DataFrame
    buckets: int

    @classmethod
    def build(cls, movies: DataFrame, path: str | None = None, buckets: int = BUCKETS, parts: int = PARTS) -> TitleIndex:
        """Write titles and posting lists. ``parts`` bounds a posting row (the titles of one part) and how finely titles are read."""
        spark = movies.sparkSession
        path = path or fresh_path(spark, "title-index")
        movies = movies if "title_form" in movies.columns else with_search_forms(dealt_out(movies))
        placed = movies.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        placed.repartition("part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(f"{path}/titles")
        titles = spark.read.schema(placed.schema).parquet(f"{path}/titles")
        both = F.array_union(pieces(F.col("title_form")), pieces(F.col("original_form")))
        found = titles.select("id", "part", F.explode(both).alias("piece"))
        lists = found.groupBy("piece", "part").agg(F.count(F.lit(1)).alias("titles"), F.sort_array(F.collect_list("id")).alias("ids"))
        lists = lists.withColumn("bucket", _bucket(F.col("piece"), buckets))
        # Sorted by piece, so that within a bucket only the row groups of a list are read.
        lists.repartition("bucket").sortWithinPartitions("bucket", "piece", "part").write.partitionBy("bucket").parquet(f"{path}/postings")
        postings = spark.read.schema(lists.schema).parquet(f"{path}/postings")
        return cls(postings, titles, buckets)

    def _lists(self, wanted: list[str]) -> DataFrame:
        """The posting rows of the keys, with the keys each belongs to; only the keys' buckets are read."""
        spark: SparkSession = self.postings.sparkSession
        found = spark.createDataFrame([(k,) for k in wanted], "key string").select(_bucket(F.col("key"), self.buckets)).distinct().collect()
        whole, begun = [k for k in wanted if len(k) == PIECE], [k for k in wanted if len(k) < PIECE]
        held = F.col("piece").isin(whole)
        for key in begun:
            held = held | F.col("piece").startswith(key)
        near = self.postings.filter(F.col("bucket").isin([r[0] for r in found]) & held)
        belongs = F.filter(F.array(*[F.when((F.col("piece") == k) if len(k) == PIECE else F.col("piece").startswith(k), F.lit(k)) for k in wanted]), lambda k: k.isNotNull())
        return near.withColumn("key", F.explode(belongs))

    def candidates(self, source: str) -> DataFrame | None:
        """(id, part) of the titles that hold a pattern's rarest pieces; None for a pattern without keys."""
        wanted = keys(source)
        if not wanted:
            return None
        sizes = {r["key"]: r["n"] for r in self._lists(wanted).groupBy("key").agg(F.sum("titles").alias("n")).collect()}
        chosen = sorted(wanted, key=lambda k: (sizes.get(k, 0), k))[:KEYS]
        if not sizes.get(chosen[0]):
            return self.titles.select("id", "part").limit(0)
        # A title meets a beginning of two characters under several pieces, and counts once.
        rows = self._lists(chosen).select("part", "key", F.explode("ids").alias("id")).distinct()
        return rows.groupBy("id", "part").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") == len(chosen)).select("id", "part")

    def hits(self, query: str, literal: bool = False) -> DataFrame:
        """Matching movies with ``relevance_score``, the same rows as ``search.hits``."""
        spark = self.titles.sparkSession
        exact, source = search_form(F.lit(query)), search_form(like_text(F.lit(query), literal))
        near = self.candidates(spark.range(1).select(source.alias("s")).head()["s"])
        titles = self.titles
        if near is not None:
            parts = [r["part"] for r in near.select("part").distinct().collect()]
            titles = titles.filter(F.col("part").isin(parts)).join(near.select("id"), "id", "left_semi")
        match, score = relevance(exact, source)
        return titles.filter(match).withColumn("relevance_score", score).drop("part")
