"""Raw CSV inputs: every column read as text, missing-value spellings nulled, row order attached."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell spellings read as missing, compared with case.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ROW = "row_id"


@dataclass(frozen=True)
class RawFile:
    """A named CSV layout. ``multiline`` says that quoted cells may hold line breaks; only then must
    Spark read a file in one piece, all other files are split."""

    name: str
    columns: Sequence[str]
    multiline: bool = False


# The input bundle of the film catalogue.
RAW_FILES = {
    f.name: f
    for f in (
        RawFile("movies_metadata", (
            "adult", "belongs_to_collection", "budget", "genres", "homepage", "id", "imdb_id",
            "original_language", "original_title", "overview", "popularity", "poster_path",
            "production_companies", "production_countries", "release_date", "revenue", "runtime",
            "spoken_languages", "status", "tagline", "title", "video", "vote_average", "vote_count",
        ), multiline=True),
        RawFile("credits", ("cast", "crew", "id"), multiline=True),
        RawFile("keywords", ("id", "keywords"), multiline=True),
        RawFile("links", ("movieId", "imdbId", "tmdbId")),
        RawFile("links_small", ("movieId", "imdbId", "tmdbId")),
        RawFile("ratings", ("userId", "movieId", "rating", "timestamp")),
        RawFile("ratings_small", ("userId", "movieId", "rating", "timestamp")),
        RawFile("poster_feed", ("id", "poster_path"), multiline=True),
    )
}


def null_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Null the cells that spell a missing value."""
    names = list(columns if columns is not None else (f.name for f in df.schema.fields if f.dataType == T.StringType()))
    return df.withColumns({c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c in names})


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multiline: bool = False,
    missing: bool | Sequence[str] = True, row_order: bool = True,
) -> DataFrame:
    """Read CSV with a header as text columns.

    Columns are matched by the header's names, so files may hold more. ``missing`` says which columns spell missing values: all,
    none, or those named. Other columns keep every text as it stands; in them a cell of two quotes is an empty text and one
    of nothing is null. ``row_id`` is a struct that
    sorts in file order: file, then block, then position within it. Every multi-line file is one task, so give
    large inputs as several files, and store the result once (``ingest``) before running jobs on it.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multiline, encoding="UTF-8")
    reader = reader.options(enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # Unset, the first is U+0000, which then goes from quoted cells; and Spark nulls cells that equal the second, so none may.
    reader = reader.options(charToEscapeQuoteEscaping='"', nullValue=uuid.uuid4().hex)
    header = spark.read.options(header=True, quote='"', escape='"', multiLine=multiline).csv(path).columns
    df = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    wanted = [c for c in columns if c in header] if columns else header
    if row_order:
        position = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
        )
        df = df.select(*wanted, position.alias(ROW))
    else:
        df = df.select(*wanted)
    spelt = wanted if missing is True else [c for c in wanted if c in (missing or ())]
    return null_missing(df, spelt)


def read_raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file of the bundle below a folder."""
    spec = RAW_FILES[name]
    return read_csv(spark, f"{folder}/{name}.csv", spec.columns, spec.multiline)


def ingest(df: DataFrame, path: str) -> DataFrame:
    """Store a raw table as Parquet, row order included, and read it back splittable and columnar."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def probe(df: DataFrame, n: int = 5, order: Sequence[str] = (ROW,)) -> tuple[int, DataFrame]:
    """Row count and the first ``n`` rows, without profiling the rest."""
    return df.count(), df.orderBy(*order).limit(n)
