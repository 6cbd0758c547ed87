"""Cleaning pipelines of the four raw files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import coerce
from marquee.operators import cleaning as c
from marquee.operators.dedup import drop_full_duplicates, first_by_key

# The columns a cleaned movie keeps, in order.
MOVIE_COLUMNS = (
    "id", "imdb_id", "title", "original_title", "original_language", "overview", "tagline", "release_date", "runtime",
    "budget", "revenue", "popularity", "vote_average", "vote_count", "status", "adult", "genres", "production_companies",
    "production_countries", "spoken_languages", "belongs_to_collection", "poster_path",
)
TEXTS = ("title", "original_title", "overview", "tagline")
MEASURES = ("budget", "revenue", "runtime", "vote_average", "popularity")


def movie_steps(strict: bool = False) -> list[c.Step]:
    """The movie rules in order. ``strict`` adds the two optional masks for short texts and few votes."""
    steps = [
        c.drop_shifted("id"),
        c.cast_types(whole=("id", "vote_count"), real=("budget", "popularity", "runtime", "revenue", "vote_average")),
        c.parse_day("release_date"),
        c.drop_adult("adult"),
        *c.zero_to_null("budget", "revenue", "popularity"),
        c.null_rating_without_votes(),
        *c.zero_to_null("runtime"),
        c.null_long_runtime("runtime", 300),
        c.null_tiny_budget("budget", 1000),
        *c.tidy_space(*TEXTS),
        c.null_placeholders("overview"),
        c.fill_missing("status", "Unknown"),
    ]
    return [*steps, c.null_short_text("overview"), c.null_rating_with_few_votes()] if strict else steps


def clean_movies(raw: DataFrame, order: Sequence[str], strict: bool = False) -> DataFrame:
    """Cleaned movies, unique by imdb id (the first row wins, one row without an id remains)."""
    unique = first_by_key(c.clean(raw, movie_steps(strict)), ["imdb_id"], order)
    kept, _ = c.keep_columns(unique, [*MOVIE_COLUMNS, *order])
    return kept


def movies_audit(raw: DataFrame) -> DataFrame:
    """What each movie rule touched."""
    return c.audit(raw, movie_steps())


def movies_completeness(cleaned: DataFrame) -> DataFrame:
    return c.completeness(cleaned, [m for m in MEASURES if m in cleaned.columns])


def clean_credits(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Without full duplicates, then the first row of each id."""
    return first_by_key(drop_full_duplicates(raw, order), ["id"], order)


def clean_keywords(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Without full duplicates; equal ids with different content stay."""
    return drop_full_duplicates(raw, order)


def clean_links(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with a film id, as a whole number, the first of each."""
    rows = c.clean(raw, [c.drop_missing("tmdbId")])
    whole = coerce.whole_of(F.col("tmdbId"), dict(rows.dtypes)["tmdbId"], "tmdbId")
    return first_by_key(rows.withColumn("tmdbId", whole), ["tmdbId"], order)
