"""From raw documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's result as Parquet to the shared folder and reads it again, so a lost executor costs
one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bottomk, suffix_spans, vector_pack, weak_quality, winnow_lines
from marquee.llm.common import stored

HAS_WORD = r"[^\x20\x09-\x0D]"


def _counted(docs: DataFrame) -> DataFrame:
    """Character counts that fit the texts."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither scorer rejects."""
    found = weak_quality.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.where(weak_quality.KEEP).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; documents of which nothing is left go."""
    found = winnow_lines.dedup_lines(docs)
    whole = (F.col("winnow_deleted") == 0) | F.col("text").rlike(HAS_WORD)
    return _counted(found.where(whole).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return bottomk.deduplicated(docs).select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier text holds; documents of which nothing is left go."""
    return _counted(suffix_spans.without_spans(docs).select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences."""
    return vector_pack.piece_digests(vector_pack.pack(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("packing", packing),
]

#: SQL cannot express the classifier, the sketches or the tokenizer; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
