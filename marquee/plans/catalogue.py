"""The catalogue: its tables, its page type and the argument guards all queries share."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.arrays import empty_if_null, names_by_item

# Bounds of the public query arguments.
MAX_PAGE_SIZE = 100
DEFAULT_PAGE_SIZE = 20


class InvalidArgument(ValueError):
    """A query argument out of bounds; ``code`` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Catalogue:
    """Tables a query may use. ``movies`` has the columns of the summary; relations default to none."""

    movies: DataFrame
    genres: DataFrame | None = None
    movie_genres: DataFrame | None = None
    embeddings: DataFrame | None = None
    others: Mapping[str, DataFrame] | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return (self.others or {})[name]


@dataclass(frozen=True)
class Page:
    """One page of a result and the size of the whole result."""

    items: DataFrame
    page: int
    page_size: int
    total: int

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total / self.page_size) if self.total else 0


def check_page(page: int, page_size: int) -> int:
    """The row offset of a page, or an error for arguments out of bounds."""
    if page < 1:
        raise InvalidArgument("invalid_page", f"page must be at least 1, got {page}")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise InvalidArgument("invalid_page_size", f"page size must be 1 to {MAX_PAGE_SIZE}, got {page_size}")
    return (page - 1) * page_size


def check_min_votes(min_votes: int | None) -> None:
    if min_votes is not None and min_votes < 0:
        raise InvalidArgument("invalid_min_vote_count", f"minimum vote count cannot be negative, got {min_votes}")


def summary(movies: DataFrame) -> DataFrame:
    """The card columns of movies; genres are attached by ``with_genres``."""
    return movies.select(
        "id", "title", F.year("release_date").alias("year"), "poster_path", "vote_average", "vote_count", "popularity"
    )


def genre_arrays(catalogue: Catalogue, links: DataFrame | None = None) -> DataFrame:
    links = catalogue.movie_genres if links is None else links
    return names_by_item(links, catalogue.genres, "genre_id", "id", "genres").withColumnRenamed("movie_id", "id")


def with_genres(catalogue: Catalogue, page: DataFrame) -> DataFrame:
    """Attach genre arrays to one page of results.

    A page has at most ``MAX_PAGE_SIZE`` rows, so its rows are fetched once and its ids become an ``IN`` filter that
    the Parquet scan of the (large) link table uses to skip row groups.
    """
    rows = page.collect()
    schema = T.StructType([*page.schema.fields, T.StructField("_place", T.IntegerType())])
    fixed = page.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    links = catalogue.movie_genres.filter(F.col("movie_id").isin([r["id"] for r in rows]))
    full = empty_if_null(fixed.join(genre_arrays(catalogue, links), "id", "left"), "genres")
    card = [c for c in page.columns if c != "similarity"]
    return full.orderBy("_place").select(*card, "genres", *[c for c in page.columns if c == "similarity"])


def genre_names(catalogue: Catalogue) -> DataFrame:
    """All genre names in ascending (binary) order."""
    return catalogue.genres.select("name").orderBy("name")
