"""Profiling reports over raw tables.

Per-column measures of a table share one aggregation pass. Reports by value melt the columns into
(column, value) rows and count them with map-side combining; nothing unbounded reaches the driver.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import coerce
from marquee.operators.nested import JSON_OPTIONS, MIXED_LIST, SIMPLE_LIST, last_character, with_json
from marquee.operators.quantiles import approximate_quantiles, exact_quantiles, quantiles_of_counts
from marquee.session import dealt_out, staged

# Phrases counted as placeholder text (compared in lower case, not trimmed), and the
# plausible calendar of releases.
PLACEHOLDERS = (
    "n/a", "no overview found.", "tbd", "no description", "no description available", "no overview", "-", "none",
)
FIRST_PLAUSIBLE = "1880-01-01"
LAST_PLAUSIBLE = "2030-01-01"
# No literal of any kind ends with one of these; only a comment could.
NEVER_LAST = r"[:{(\[]"


def _unfold(df: DataFrame, measures: Mapping[str, Mapping[str, Column]], label: str = "column") -> DataFrame:
    """One row per key of ``measures`` with its aggregates as columns, from a single pass."""
    keys = list(measures)
    names = list(next(iter(measures.values())))
    flat = [measures[k][m].alias(f"m{i}_{m}") for i, k in enumerate(keys) for m in names]
    rows = [F.struct(F.lit(k).alias(label), *[F.col(f"m{i}_{m}").alias(m) for m in names]) for i, k in enumerate(keys)]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def basic_stats(df: DataFrame) -> DataFrame:
    """(position, column, dtype, rows, columns)."""
    names = [F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("dtype")) for i, (n, t) in enumerate(df.dtypes)]
    counted = df.agg(F.count("*").alias("rows"))
    return counted.select(F.inline(F.array(*names)), "rows", F.lit(len(df.columns)).alias("columns"))


def missing(df: DataFrame) -> DataFrame:
    """(column, missing, pct) of the columns with nulls, most first."""
    per = {c: {"missing": F.count_if(F.col(f"`{c}`").isNull()), "n": F.count("*")} for c in df.columns}
    report = _unfold(df, per).filter("missing > 0")
    return report.select("column", "missing", _pct(F.col("missing"), F.col("n")).alias("pct")).orderBy(F.desc("missing"), "column")


def full_duplicates(df: DataFrame) -> DataFrame:
    """(duplicates): rows beyond the first of identical content."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, rows_involved): rows sharing their value of the key with another row; nulls are equal."""
    parts = []
    for key in _present(df, keys):
        groups = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_involved")).select(F.lit(key).alias("key"), "rows_involved"))
    return reduce(DataFrame.unionByName, parts)


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.select([coerce.number_of(F.col(c), types[c]).alias(c) for c in _present(df, columns)])


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, zeros, negatives, non_numeric)."""
    return _unfold(df, {c: _numeric_measures(df, c) for c in _present(df, columns)})


def _numeric_measures(df: DataFrame, c: str) -> dict[str, Column]:
    v = coerce.number_of(F.col(c), dict(df.dtypes)[c])
    return {
        "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "zeros": F.count_if(v == 0),
        "negatives": F.count_if(v < 0), "non_numeric": F.count_if(v.isNull() & F.col(c).isNotNull()),
    }


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5, 0.9, 0.99), exact: bool = True) -> DataFrame:
    """(column, p, quantile), exact with linear interpolation or from a sketch."""
    numbers = _numbers(df, columns)
    return (exact_quantiles if exact else approximate_quantiles)(numbers, numbers.columns, probs)


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """(column, rank, value): the n largest numbers of each column."""
    numbers = _numbers(df, columns)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in numbers.columns]
    rows = numbers.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    # The rank limit is applied before the shuffle, so each task sends n rows per column.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("value")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select("column", "rank", "value")


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in _present(df, columns)]
    rows = df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    return rows.groupBy("column", "value").agg(F.count("*").alias("count"))


def cardinality(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """(column, distinct): number of distinct non-null values."""
    if not exact:
        return _unfold(df, {c: {"distinct": F.approx_count_distinct(c)} for c in _present(df, columns)})
    return _value_counts(df, columns).groupBy("column").agg(F.count("*").alias("distinct"))


def value_counts(df: DataFrame, columns: Sequence[str], n: int = 3) -> DataFrame:
    """(column, rank, value, count, pct): the most frequent values; pct is of all rows, ties go by value."""
    counts = _value_counts(df, columns)
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= n)
    rows = df.agg(F.count("*").alias("n")).scalar()
    return top.select("column", "rank", "value", "count", _pct(F.col("count"), rows).alias("pct"))


def date_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, earliest, latest, before_1880, after_2030, unparseable)."""
    return _unfold(df, {c: _date_measures(df, c) for c in _present(df, columns)})


def _date_measures(df: DataFrame, c: str) -> dict[str, Column]:
    day = coerce.day_of(F.col(c), dict(df.dtypes)[c])
    return {
        "earliest": F.min(day), "latest": F.max(day),
        "before_1880": F.count_if(day < F.lit(FIRST_PLAUSIBLE).cast("date")),
        "after_2030": F.count_if(day > F.lit(LAST_PLAUSIBLE).cast("date")),
        "unparseable": F.count_if(day.isNull() & F.col(c).isNotNull()),
    }


def text_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, present, avg_length, min_length, max_length, short, placeholders)."""
    return _unfold(df, {c: _text_measures(df, c) for c in _present(df, columns)})


def _text_measures(df: DataFrame, c: str) -> dict[str, Column]:
    size = F.length(c)
    return {
        "present": F.count(c), "avg_length": F.avg(size), "min_length": F.min(size), "max_length": F.max(size),
        "short": F.count_if(size < 10), "placeholders": F.count_if(F.lower(c).isin(*PLACEHOLDERS)),
    }


def space_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, leading, trailing, double_space, tab, carriage_return, nbsp, unicode_escape)."""
    return _unfold(df, {c: _space_measures(df, c) for c in _present(df, columns)})


def _space_measures(df: DataFrame, c: str) -> dict[str, Column]:
    text = F.col(c)
    return {
        "leading": F.count_if(text.startswith(" ")), "trailing": F.count_if(text.endswith(" ")),
        "double_space": F.count_if(text.contains("  ")), "tab": F.count_if(text.contains("\t")),
        "carriage_return": F.count_if(text.contains("\r")), "nbsp": F.count_if(text.contains("\u00a0")),
        "unicode_escape": F.count_if(text.rlike(r"\\u[0-9a-fA-F]{4}")),
    }


def cell_quality(
    df: DataFrame, columns: Sequence[str], sample: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """(column, cells, parsed, failed, empty_lists) of literal cells.

    ``sample`` looks at the first so many non-null cells in the given order, instead of all.
    """
    parts = []
    for c in _present(df, columns):
        cells = df.filter(F.col(c).isNotNull())
        if sample is not None:
            cells = cells.orderBy(*order).limit(sample)
        parts.append(
            _cell_states(cells.select(F.col(c).alias("cell"))).agg(
                F.count("*").alias("cells"), F.count_if(F.col("state") != "failed").alias("parsed"),
                F.count_if(F.col("state") == "failed").alias("failed"),
                F.count_if(F.col("state") == "empty_list").alias("empty_lists"),
            ).select(F.lit(c).alias("column"), "cells", "parsed", "failed", "empty_lists")
        )
    return reduce(DataFrame.unionByName, parts)


def _cell_states(cells: DataFrame) -> DataFrame:
    """(state) of the literal cells in the only column."""
    return _with_state(dealt_out(cells), "state", cells.columns[0]).select("state")


def _with_state(df: DataFrame, alias: str, cell: str) -> DataFrame:
    """Add the state of a literal cell: ``failed``, ``empty_list``, ``ok``, or null for a null cell.

    Lists of dicts and cells that break off are judged in the JVM, most of them by one pattern without being parsed; other cells by Python's own reader.
    """
    kept = [c for c in df.columns if c != alias]

    def judge(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return "empty_list" if ast.literal_eval(text) == [] else "ok"
        except Exception:
            return "failed"

    @F.arrow_udf("string")
    def judged(cells: pa.Array) -> pa.Array:
        if cells.null_count == len(cells):
            return pa.nulls(len(cells), pa.string())
        return pa.array([judge(c) for c in cells.to_pylist()], type=pa.string())

    text = F.col(cell)
    told = F.when(text == "[]", "empty_list").when(text.endswith("]") & (text.rlike(SIMPLE_LIST) | text.rlike(MIXED_LIST)), "ok")
    df = df.withColumn("_told", told.when(last_character(text).rlike(NEVER_LAST) & ~text.contains("#"), "failed"))
    df = df.withColumn("_untold", F.when(F.col("_told").isNull(), text))
    df = with_json(df, "_json", "_untold")
    df = df.withColumn("_read", F.from_json("_json", "v array<struct<any:string>>, _bad string", JSON_OPTIONS))
    df = df.withColumn("_good", F.coalesce(F.col("_json").isNotNull() & F.col("_read._bad").isNull(), F.lit(False)))
    df = df.withColumn("_rest", judged.asNondeterministic()(F.when(~F.col("_good"), F.col("_untold"))))
    native = F.when(F.size("_read.v") == 0, "empty_list").otherwise("ok")
    return df.select(*kept, F.when(F.col("_told").isNotNull(), F.col("_told")).when(F.col("_good"), native).otherwise(F.col("_rest")).alias(alias))


def tag_coverage(df: DataFrame, column: str) -> DataFrame:
    """(null_cells, empty_cells, unreadable_cells, without_tags, pct): rows effectively without tags."""
    states = _cell_states(df.select(column))
    counts = states.agg(
        F.count("*").alias("n"), F.count_if(F.col("state").isNull()).alias("null_cells"),
        F.count_if(F.col("state") == "empty_list").alias("empty_cells"),
        F.count_if(F.col("state") == "failed").alias("unreadable_cells"),
    ).withColumn("without_tags", F.col("null_cells") + F.col("empty_cells") + F.col("unreadable_cells"))
    return counts.select(
        "null_cells", "empty_cells", "unreadable_cells", "without_tags", _pct(F.col("without_tags"), F.col("n")).alias("pct")
    )


def shifted_rows(df: DataFrame, columns: Sequence[str] = ("id", "budget")) -> DataFrame:
    """(column, non_numeric): cells that should be numeric and are not."""
    return numeric_profile(df, columns).select("column", "non_numeric")


def shifted_samples(df: DataFrame, column: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first few non-numeric cells of a column, in row order."""
    odd = df.filter(F.col(column).isNotNull() & coerce.number_of(F.col(column), dict(df.dtypes)[column]).isNull())
    return odd.orderBy(*order).limit(n).select(F.lit(column).alias("column"), F.col(column).alias("cell"))


def unexpected_values(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """(value): distinct non-null values outside the expected ones."""
    text = df.select(F.col(column).cast("string").alias("value"))
    return text.filter(F.col("value").isNotNull() & ~F.col("value").isin(*expected)).distinct()


def semantic_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(rows_involved): rows that share all key columns, none null, with another row."""
    groups = df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_involved"))


def semantic_duplicate_samples(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows, in row order, that share the key with another row.

    Only a key's first n rows can be among them, so each key is cut to n before the shuffle while its full
    count comes from a combined aggregation.
    """
    rows = df.dropna(subset=list(key)).select(*dict.fromkeys([*key, *order]))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    heads = rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    repeated = rows.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return heads.join(repeated, list(key), "left_semi").orderBy(*order).limit(n)


def rating_coverage(df: DataFrame, user: str, item: str) -> DataFrame:
    """(users, items, ratings, avg_per_user)."""
    per = cardinality(df, [user, item])
    counts = per.agg(
        F.max(F.when(F.col("column") == user, F.col("distinct"))).alias("users"),
        F.max(F.when(F.col("column") == item, F.col("distinct"))).alias("items"),
    )
    n = df.agg(F.count("*").alias("n")).scalar()
    out = counts.select(F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("items", F.lit(0)).alias("items"), n.alias("ratings"))
    return out.withColumn("avg_per_user", F.when(F.col("users") > 0, F.col("ratings") / F.col("users")))


def compare_sets(small: DataFrame, full: DataFrame, column: str, full_column: str | None = None) -> DataFrame:
    """(in_small, in_full, overlap, only_small, only_full, is_subset) over distinct values."""
    # Distinct non-null-safe values are tagged and met once: a single shuffle per side, no pair of rows kept.
    mine = small.select(F.col(column).alias("v")).distinct().withColumn("side", F.lit(1))
    theirs = full.select(F.col(full_column or column).alias("v")).distinct().withColumn("side", F.lit(2))
    sides = mine.unionByName(theirs).groupBy("v").agg(F.sum("side").alias("sides"))
    counts = sides.agg(
        F.count_if(F.col("sides").isin(1, 3)).alias("in_small"), F.count_if(F.col("sides").isin(2, 3)).alias("in_full"),
        F.count_if(F.col("sides") == 3).alias("overlap"), F.count_if(F.col("sides") == 1).alias("only_small"),
        F.count_if(F.col("sides") == 2).alias("only_full"),
    )
    return counts.withColumn("is_subset", (F.col("only_small") == 0) & (F.col("in_small") > 0))


def profile(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """(section, subject, metric, value): the whole profile of a file as one long table.

    ``spec`` names the columns of each section: ``keys``, ``numeric``, ``categorical``, ``dates``, ``texts``, ``spaces``
    and ``cells``; ``basic`` and ``missing`` always run. The file is read twice, whatever the sections: one aggregation holds all measures of rows, and one
    shuffle of (kind, column, value) counts serves duplicates, cardinality and quantiles.
    """
    chosen = {section: _present(df, spec.get(section, ())) for section in ("keys", "numeric", "categorical", "dates", "texts", "spaces", "cells")}
    row_level = {"numeric": _numeric_measures, "dates": _date_measures, "texts": _text_measures, "spaces": _space_measures}
    epoch = F.lit("1970-01-01").cast("date")

    # Measures of rows.
    n = F.count("*")
    cells = [("basic", "table", "rows", n, True), ("basic", "table", "columns", F.max(F.lit(len(df.columns))), True)]
    for c in df.columns:
        lacking = F.count_if(F.col(f"`{c}`").isNull())
        cells += [("missing", c, "missing", lacking, lacking > 0), ("missing", c, "pct", _pct(lacking, n), lacking > 0)]
    for section, measures in row_level.items():
        for c in chosen[section]:
            for metric, value in measures(df, c).items():
                cells.append((section, c, metric, F.date_diff(value, epoch) if metric in ("earliest", "latest") else value, True))
    judged = df
    for i, c in enumerate(chosen["cells"]):
        judged, state = _with_state(judged, f"_state{i}", c), F.col(f"_state{i}")
        for metric, held in (("cells", state.isNotNull()), ("parsed", state != "failed"), ("failed", state == "failed"), ("empty_lists", state == "empty_list")):
            cells.append(("cells", c, metric, F.count_if(held), True))
    flat = judged.agg(*[value.cast("double").alias(f"v{i}") for i, (*_, value, _) in enumerate(cells)], *[F.lit(shown).alias(f"s{i}") for i, (*_, shown) in enumerate(cells)])
    rows = [F.struct(F.lit(section).alias("section"), F.lit(subject).alias("subject"), F.lit(metric).alias("metric"), F.col(f"v{i}").alias("value"), F.col(f"s{i}").alias("shown"))
            for i, (section, subject, metric, _, _) in enumerate(cells)]
    measured = flat.select(F.inline(F.array(*rows))).filter("shown").drop("shown")

    # Counts of values. A row's content is told by a digest; nulls are values of rows and keys only.
    def entry(kind: str, c: str, text: Column | None = None, number: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if number is None else number).cast("double").alias("v"))

    types = dict(df.dtypes)
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    entries = [entry("row", "rows", content), *(entry("key", c, F.col(c)) for c in chosen["keys"]), *(entry("value", c, F.col(c)) for c in chosen["categorical"]),
               *(entry("number", c, number=coerce.number_of(F.col(c), types[c])) for c in chosen["numeric"])]
    long = df.select(F.inline(F.array(*entries))).filter(F.col("kind").isin("row", "key") | F.col("text").isNotNull() | F.col("v").isNotNull())
    counts = staged(long.groupBy("kind", "column", "text", "v").agg(F.count("*").alias("m")), "profile-counts")
    sums = counts.groupBy("kind", "column").agg(F.sum(F.col("m") - 1).alias("beyond"), F.sum(F.when(F.col("m") > 1, F.col("m"))).alias("involved"), F.count("*").alias("values"))

    def known(kind: str, names: Sequence[str], section: str, metric: str, value: str) -> DataFrame:
        """A metric of every named column, 0 where it has no values."""
        frame = df.sparkSession.createDataFrame([(c,) for c in names], "subject string")
        own = sums.filter(F.col("kind") == kind).select(F.col("column").alias("subject"), F.col(value).cast("double").alias("value"))
        return frame.join(own, "subject", "left").select(F.lit(section).alias("section"), "subject", F.lit(metric).alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value"))

    parts = [measured, known("row", ["rows"], "duplicates", "duplicates", "beyond")]
    if chosen["keys"]:
        parts.append(known("key", chosen["keys"], "duplicates", "rows_involved", "involved"))
    if chosen["categorical"]:
        with_values = sums.filter(F.col("kind") == "value")
        parts.append(with_values.select(F.lit("categorical").alias("section"), F.col("column").alias("subject"), F.lit("distinct").alias("metric"), F.col("values").cast("double").alias("value")))
    if chosen["numeric"]:
        q = quantiles_of_counts(counts.filter(F.col("kind") == "number").select("column", "v", "m"))
        named = F.concat(F.lit("p"), F.round(F.col("p") * 100).cast("int").cast("string"))
        parts.append(q.select(F.lit("numeric").alias("section"), F.col("column").alias("subject"), named.alias("metric"), F.col("quantile").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def cross_file_report(movies: DataFrame, credits: DataFrame, keywords: DataFrame, key: str = "id") -> DataFrame:
    """(measure, n): distinct ids of three files and the ids each lacks of the others. Each file is read once; all ids meet in one shuffle."""
    def ids(df: DataFrame, mark: int) -> DataFrame:
        number = coerce.number_of(F.col(key), dict(df.dtypes)[key]).cast("bigint")
        return df.select(number.alias("id"), F.lit(mark).alias("mark")).filter("id is not null")

    marks = ids(movies, 1).union(ids(credits, 2)).union(ids(keywords, 4)).groupBy("id").agg(F.bit_or("mark").alias("marks"))

    def held(mark: int, without: int = 0) -> Column:
        inside = F.col("marks").bitwiseAND(F.lit(mark)) > 0
        return F.count_if(inside & (F.col("marks").bitwiseAND(F.lit(without)) == 0))

    measures = {
        "movies": held(1), "credits": held(2), "keywords": held(4), "credits_without_movie": held(2, 1), "keywords_without_movie": held(4, 1),
        "movies_without_credits": held(1, 2), "movies_without_keywords": held(1, 4),
    }
    counted = marks.agg(*[count.alias(name) for name, count in measures.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).alias("n")) for name in measures])))
