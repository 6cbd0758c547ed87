"""Filtered, sorted and paged listing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.plans.catalogue import (
    DEFAULT_PAGE_SIZE, Catalogue, InvalidArgument, Page, check_min_votes, check_page, summary, with_genres,
)

# Sort keys and the vote threshold a rating sort implies.
SORT_COLUMNS = {
    "popularity": "popularity", "voteAverage": "vote_average", "voteCount": "vote_count",
    "releaseDate": "release_date", "title": "title",
}
RATING_SORT_MIN_VOTES = 10


@dataclass(frozen=True)
class Filters:
    """All given filters must hold; several genres mean "any of them"."""

    genres: Sequence[str] = ()
    year: int | None = None
    year_from: int | None = None
    year_to: int | None = None
    language: str | None = None
    min_votes: int | None = None


def _checked(filters: Filters, sort: str) -> Filters:
    if filters.year_from is not None and filters.year_to is not None and filters.year_from > filters.year_to:
        raise InvalidArgument("invalid_year_range", f"{filters.year_from} is after {filters.year_to}")
    check_min_votes(filters.min_votes)
    if sort == "voteAverage" and filters.min_votes is None:
        return replace(filters, min_votes=RATING_SORT_MIN_VOTES)
    return filters


def _released(year: int) -> Column:
    """First day of a year; outside the calendar of dates the bound is the calendar's end."""
    return F.lit(dt.date(min(max(year, dt.MINYEAR), dt.MAXYEAR), 1, 1))


def matching(catalogue: Catalogue, filters: Filters) -> DataFrame:
    """Movies that pass the filters. Years become date ranges, which the Parquet scan can use."""
    movies, day = catalogue.movies, F.col("release_date")
    first = [y for y in (filters.year, filters.year_from) if y is not None]
    last = [y for y in (filters.year, filters.year_to) if y is not None]
    for y in first:
        movies = movies.filter(day >= _released(y)) if y <= dt.MAXYEAR else movies.filter(F.lit(False))
    for y in last:
        movies = movies.filter(day < _released(y + 1)) if y < dt.MAXYEAR else movies.filter(day.isNotNull())
    if filters.language is not None:
        movies = movies.filter(F.col("original_language") == filters.language)
    if filters.min_votes is not None:
        movies = movies.filter(F.col("vote_count") >= filters.min_votes)
    if filters.genres:
        wanted = catalogue.genres.filter(F.col("name").isin(*filters.genres)).select(F.col("id").alias("genre_id"))
        tagged = catalogue.movie_genres.join(wanted, "genre_id", "left_semi").select(F.col("movie_id").alias("id")).distinct()
        movies = movies.join(tagged, "id", "left_semi")
    return movies


def ordering(sort: str = "popularity", direction: str = "desc") -> list[Column]:
    """Sort columns with nulls last in both directions and the id as tie-break."""
    if sort not in SORT_COLUMNS or direction not in ("asc", "desc"):
        raise InvalidArgument("invalid_sort", f"cannot sort by {sort} {direction}")
    column = F.col(SORT_COLUMNS[sort])
    return [column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last(), F.col("id").asc()]


def rows_after(movies: DataFrame, sort: str, direction: str, value, movie_id: int) -> DataFrame:
    """The movies that come after one with this sort value (None: null, which sorts last) and id."""
    ordering(sort, direction)
    column, later = F.col(SORT_COLUMNS[sort]), F.col("id") > movie_id
    if value is None:
        return movies.filter(column.isNull() & later)
    beyond = column > F.lit(value) if direction == "asc" else column < F.lit(value)
    return movies.filter(beyond | ((column == F.lit(value)) & later) | column.isNull())


def listing_after(
    catalogue: Catalogue, filters: Filters = Filters(), sort: str = "popularity", direction: str = "desc",
    after: tuple | None = None, page_size: int = DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """The next rows after ``after``, the (sort value, id) of the last row shown; the first ones without it.

    However deep the page, only ``page_size`` rows are sorted out of what follows, and the scan skips what comes before; ``listing`` with its page
    numbers sorts its whole offset and is meant for early pages.
    """
    check_page(1, page_size)
    found = matching(catalogue, _checked(filters, sort))
    found = found if after is None else rows_after(found, sort, direction, *after)
    keys = found.select("id", "title", "release_date", "poster_path", "vote_average", "vote_count", "popularity")
    return with_genres(catalogue, summary(keys.orderBy(*ordering(sort, direction)).limit(page_size)))


def listing(
    catalogue: Catalogue, filters: Filters = Filters(), sort: str = "popularity", direction: str = "desc",
    page: int = 1, page_size: int = DEFAULT_PAGE_SIZE,
) -> Page:
    """One page of the matching movies with their genres, and how many match in all."""
    offset = check_page(page, page_size)
    order = ordering(sort, direction)
    found = matching(catalogue, _checked(filters, sort))
    keys = found.select("id", "title", "release_date", "poster_path", "vote_average", "vote_count", "popularity")
    rows = summary(keys.orderBy(*order).offset(offset).limit(page_size))
    return Page(with_genres(catalogue, rows), page, page_size, found.count())
