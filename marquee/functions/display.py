"""Presentation rules of result cards, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image base address, separator and star mark.
IMAGE_BASE = "https://image.tmdb.org/t/p/w300"
DOT = " · "
STAR = "★ "


def image_url(path: Column, base: str = IMAGE_BASE) -> Column:
    return F.concat(F.lit(base), path)


def one_decimal(value: Column) -> Column:
    """Truncate (not round) towards zero to one decimal."""
    return (value.cast("double") * 10).cast("int") / F.lit(10.0)


def shown_rating(average: Column, votes: Column) -> Column:
    """The truncated rating, only where at least one vote backs it."""
    return F.when(F.coalesce(votes, F.lit(0)) > 0, one_decimal(average))


def first_names(names: Column, n: int) -> Column:
    return F.slice(names, 1, n)


def card_line(year: Column, average: Column, votes: Column, names: Column, n: int = 2) -> Column:
    """``1999 · ★ 8.4 · Drama, Thriller`` with absent parts left out."""
    stars = F.concat(F.lit(STAR), shown_rating(average, votes).cast("string"))
    tags = F.when(F.size(names) > 0, F.array_join(first_names(names, n), ", "))
    return F.concat_ws(DOT, year.cast("string"), stars, tags)


def iso_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def year_text(iso: Column) -> Column:
    return F.substring(iso, 1, 4)
