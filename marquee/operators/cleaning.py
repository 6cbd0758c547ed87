"""Cleaning rules as steps: one list of steps drives both the cleaned table and its audit.

A step names the rows it touches and either drops them or rewrites columns of them. ``clean`` chains
the steps lazily, so a whole pipeline is one pass over the input without a shuffle; ``audit`` counts
what every step touched, also in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import coerce
from marquee.functions.text import one_line

# Phrases that stand for a missing description.
PLACEHOLDERS = (
    "n/a", "no overview found.", "no overview found", "tbd", "no description",
    "no description available", "no overview", "-", "none",
)


@dataclass(frozen=True)
class Step:
    """``hits`` gives the touched rows; ``rewrite`` the new columns, or None where hit rows are dropped."""

    label: str
    hits: Callable[[DataFrame], Column]
    rewrite: Callable[[DataFrame], dict[str, Column]] | None
    needs: tuple[str, ...] = field(default=())

    def applies(self, df: DataFrame) -> bool:
        return all(name in df.columns for name in self.needs)


def clean(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """Run the steps in order; a step whose columns are absent is skipped."""
    for step in steps:
        if step.applies(df):
            df = df.filter(~step.hits(df)) if step.rewrite is None else df.withColumns(step.rewrite(df))
    return df


def audit(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """One row per step: rows reaching it, rows it touched, rows left and the share removed."""
    labels, flagged = [], df.withColumn("_alive", F.lit(True))
    for step in steps:
        if not step.applies(flagged):
            continue
        i, alive = len(labels), F.col("_alive")
        flagged = flagged.withColumns({f"_in{i}": alive, f"_hit{i}": alive & step.hits(flagged)})
        if step.rewrite is None:
            flagged = flagged.withColumn("_alive", F.col(f"_in{i}") & ~F.col(f"_hit{i}"))
        else:
            flagged = flagged.withColumns({n: F.when(F.col(f"_in{i}"), c) for n, c in step.rewrite(flagged).items()})
        labels.append((step.label, step.rewrite is None))
    counts = flagged.agg(*[F.count_if(f"_{kind}{i}").alias(f"{kind}{i}") for i in range(len(labels)) for kind in ("in", "hit")])
    rows = [
        F.struct(
            F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.col(f"in{i}").alias("rows_in"),
            F.col(f"hit{i}").alias("affected"),
            (F.col(f"in{i}") - (F.col(f"hit{i}") if drops else F.lit(0))).alias("rows_out"),
        )
        for i, (label, drops) in enumerate(labels)
    ]
    removed_share = F.when(F.col("rows_in") > 0, 100.0 * (F.col("rows_in") - F.col("rows_out")) / F.col("rows_in"))
    return counts.select(F.inline(F.array(*rows))).withColumn("removed_pct", F.coalesce(removed_share, F.lit(0.0)))


def drop_shifted(column: str = "id") -> Step:
    """Drop rows whose identifier is not numeric: their cells slipped sideways in the source file."""
    def hits(df: DataFrame) -> Column:
        return coerce.number_of(F.col(column), dict(df.dtypes)[column]).isNull()

    return Step(f"drop_shifted[{column}]", hits, None, (column,))


def cast_types(whole: Iterable[str] = (), real: Iterable[str] = ()) -> Step:
    """Coerce text columns; unreadable cells become null, a fraction in a whole column raises.

    Columns that are absent are left out. The audit counts rows with at least one cell nulled.
    """
    whole, real = tuple(whole), tuple(real)

    def rewrite(df: DataFrame) -> dict[str, Column]:
        types = dict(df.dtypes)
        out = {c: coerce.whole_of(F.col(c), types[c], c) for c in whole if c in types}
        return out | {c: coerce.number_of(F.col(c), types[c]) for c in real if c in types}

    def hits(df: DataFrame) -> Column:
        types, nulled = dict(df.dtypes), F.lit(False)
        for c in (*whole, *real):
            if c in types:
                nulled = nulled | (F.col(c).isNotNull() & coerce.number_of(F.col(c), types[c]).isNull())
        return nulled

    return Step("cast_types", hits, rewrite)


def parse_day(column: str = "release_date") -> Step:
    """Text to date; unreadable or out-of-calendar text becomes null and is counted."""
    def parsed(df: DataFrame) -> Column:
        return coerce.day_of(F.col(column), dict(df.dtypes)[column])

    def hits(df: DataFrame) -> Column:
        return F.col(column).isNotNull() & parsed(df).isNull()

    return Step(f"parse_day[{column}]", hits, lambda df: {column: parsed(df)}, (column,))


def _null_where(label: str, column: str, where: Column, needs: tuple[str, ...] = ()) -> Step:
    """Null ``column`` on rows where the condition holds; an unknown condition leaves the cell alone."""
    hit = F.coalesce(where, F.lit(False))
    return Step(label, lambda df: hit, lambda df: {column: F.when(~hit, F.col(column))}, (column, *needs))


def zero_to_null(*columns: str) -> list[Step]:
    """A zero that means "not reported"."""
    return [_null_where(f"zero_to_null[{c}]", c, F.col(c) == 0) for c in columns]


def null_rating_without_votes(rating: str = "vote_average", votes: str = "vote_count") -> Step:
    return _null_where("null_rating_without_votes", rating, F.coalesce(F.col(votes), F.lit(0)) == 0, (votes,))


def null_long_runtime(column: str = "runtime", longest: float = 300) -> Step:
    """Null (do not clip) values strictly above the limit."""
    return _null_where(f"null_long_runtime[{column}]", column, F.col(column) > longest)


def null_tiny_budget(column: str = "budget", smallest: float = 1000) -> Step:
    """Null positive amounts below the limit; zero and negative amounts are left to other rules."""
    return _null_where(f"null_tiny_budget[{column}]", column, (F.col(column) > 0) & (F.col(column) < smallest))


def null_rating_with_few_votes(rating: str = "vote_average", votes: str = "vote_count", fewest: int = 10) -> Step:
    """Null ratings that a known but small number of votes backs; off in the standard pipeline.

    The audit counts only ratings that were present.
    """
    few = F.coalesce(F.col(votes) < fewest, F.lit(False))
    return Step(
        "null_rating_with_few_votes", lambda df: few & F.col(rating).isNotNull(),
        lambda df: {rating: F.when(~few, F.col(rating))}, (rating, votes),
    )


def null_short_text(column: str = "overview", shortest: int = 30) -> Step:
    """Null text below a length in characters; off in the standard pipeline."""
    return _null_where(f"null_short_text[{column}]", column, F.length(column) < shortest)


def null_placeholders(column: str = "overview") -> Step:
    phrase = F.lower(F.trim(F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")))
    return _null_where(f"null_placeholders[{column}]", column, phrase.isin(*PLACEHOLDERS))


def tidy_space(*columns: str) -> list[Step]:
    """Collapse white space, non-breaking blanks included; the audit counts non-null cells."""
    def step(c: str) -> Step:
        return Step(f"tidy_space[{c}]", lambda df: F.col(c).isNotNull(), lambda df: {c: one_line(F.col(c))}, (c,))

    return [step(c) for c in columns]


def fill_missing(column: str = "status", value: str = "Unknown") -> Step:
    return Step(
        f"fill_missing[{column}]", lambda df: F.col(column).isNull(),
        lambda df: {column: F.coalesce(F.col(column), F.lit(value))}, (column,),
    )


def drop_adult(column: str = "adult") -> Step:
    """Drop rows flagged as adult content; a missing flag keeps the row."""
    return Step("drop_adult", lambda df: coerce.is_true(F.col(column)), None, (column,))


def drop_missing(*columns: str) -> Step:
    """Drop rows lacking any of the columns."""
    def hits(df: DataFrame) -> Column:
        missing = F.lit(False)
        for c in columns:
            missing = missing | F.col(c).isNull()
        return missing

    return Step(f"drop_missing[{','.join(columns)}]", hits, None, columns)


def keep_columns(df: DataFrame, wanted: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, in the wanted order, and the names of those that do not."""
    wanted = list(wanted)
    return df.select([c for c in wanted if c in df.columns]), [c for c in wanted if c not in df.columns]


def completeness(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Non-null count and share of each column, in one pass."""
    columns = list(columns)
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(c).alias("present"),
            F.when(F.col("_n") > 0, 100.0 * F.col(c) / F.col("_n")).alias("present_pct"),
        )
        for c in columns
    ]
    return counts.select(F.inline(F.array(*rows)))
