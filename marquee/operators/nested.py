"""Cells that hold a nested value written as a Python literal, flattened into relational tables.

Most cells are JSON but for their quotes, which the parser takes, and None: one pattern tells so. Others are cut into quoted strings and what stands between them, re-quoted as JSON and parsed inside the JVM, quotes within names and
escapes included. A cell whose last character cannot end its container is null at once. What is not a list of dicts of strings, whole numbers and None (booleans, decimals, other escapes, malformed text) goes to
``ast.literal_eval`` in Arrow batches; both ways give the same value.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import blank_to_null
from marquee.operators.dedup import first_by_key, first_values
from marquee.session import dealt_out

Fields = Mapping[str, str]  # field name -> "long" or "string"

ARROW_TYPES = {"long": pa.int64(), "string": pa.string()}
LONG_RANGE = (-(2**63), 2**63 - 1)

# Characters a plain cell may show outside its quoted strings besides brackets and None.
FILLER = ":, \t\n0123456789-"
# Stand-ins for an escaped backslash, an escaped single quote, an escaped double quote and a quote around a string; cells that hold them are left to Python.
BACKSLASH, SINGLE, DOUBLE, QUOTE = "\x01", "\x02", "\x03", "\x04"
# Quoted strings of both kinds, once their escaped quotes are stand-ins.
STRING = r"""'([^'\n\r\x00]*+)'|"([^"\n\r\x00]*+)\""""
# Escapes that JSON has too, or that are written as \u escapes for it; surrogates are left to Python.
KNOWN_ESCAPE = r"\\(?!n|r|t|b|f|a|v|x[0-9a-fA-F]{2}|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})"


CONTROLS = "".join(f"\\x{i:02x}" for i in (*range(32), 127))


def _simple(strings_without: str, items: str = "") -> tuple[str, str]:
    """Patterns of a list and of a dict: flat dicts of whole numbers, None and strings that hold no escape, no control character, no "None" and none of ``strings_without``.

    Repetitions of pairs and items are possessive, and what a string holds cannot end it, so a cell is read once, however long it is.
    """
    def quoted(mark: str) -> str:
        # A greedy run of a class of single characters is what the pattern engine reads fastest.
        inside = rf"[^{mark}N\\{CONTROLS}{strings_without}]*"
        return f"{mark}{inside}(?:N(?!one){inside})*+{mark}"

    string, number = f"(?:{quoted(chr(39))}|{quoted(chr(34))})", r"-?[1-9]\d{0,18}+|0"
    pair = f"{string}: ?(?:{string}|{number}|None)"
    one = rf"\{{(?:{pair}(?:, ?{pair})*+)?+\}}"
    item = f"(?:{one}{items and '|' + number + '|' + items})"
    return rf"\A\[(?:{item}(?:, ?{item})*+)?+\]\z", rf"\A{one}\z"


SIMPLE_LIST, SIMPLE_DICT = _simple("")
# Lists that hold numbers beside dicts, and no comma or bracket in a string, so that such a number is told by what stands before it.
MIXED_LIST = _simple(r",\[", "None")[0]
LONE_NUMBER = r"([\[,] ?)-?\d++(?=[,\]])"
# The last character, blanks aside, of what is no list or no dict; parentheses, comments and other blanks are left to Python.
NO_END = {True: r"[\w'\":,{(\[}]", False: r"[\w'\":,{(\[\]]"}


def _ddl(fields: Fields, many: bool) -> str:
    struct = "struct<" + ",".join(f"`{n}`:{t}" for n, t in fields.items()) + ">"
    return f"array<{struct}>" if many else struct


def _leaf(value, kind: str):
    if value is None or kind == "string":
        return None if value is None else str(value).encode("utf-8", "replace").decode()
    try:
        number = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return number if LONG_RANGE[0] <= number <= LONG_RANGE[1] else None


def _literal(text: str | None):
    text = (text or "").strip()
    if not text or text.lower() in ("nan", "none"):
        return None
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def _literal_udf(fields: Fields, many: bool):
    struct = pa.struct([(n, ARROW_TYPES[t]) for n, t in fields.items()])
    arrow_type = pa.list_(struct) if many else struct
    kinds = dict(fields)

    def shaped(item):
        return {n: _leaf(item.get(n), t) for n, t in kinds.items()} if isinstance(item, dict) else None

    def value(text):
        parsed = _literal(text)
        if many:
            return [shaped(item) for item in parsed] if isinstance(parsed, list) else None
        return shaped(parsed)

    @F.arrow_udf(_ddl(fields, many))
    def parse(cells: pa.Array) -> pa.Array:
        if cells.null_count == len(cells):
            return pa.nulls(len(cells), arrow_type)
        return pa.array([None if c is None else value(c) for c in cells.to_pylist()], type=arrow_type)

    # Declared so that no filter on the parsed value moves below it, which would parse every cell twice.
    return parse.asNondeterministic()


def with_json(df: DataFrame, json: str, cell: str, many: bool = True) -> DataFrame:
    """Add the cell as JSON text, an object with the value under ``v``; null for a cell that may not mean the same in JSON.

    Quotes around strings become one stand-in, whichever kind they are; what is left without the strings tells the cell's shape. The steps are separate columns
    because each is used more than once: Spark then keeps them as separate projections and evaluates each once per row.
    """
    kept, text = [c for c in df.columns if c != json], F.col(cell)
    # Cells of the most frequent kind, in which a single quote can only stand around a string.
    plain = ~reduce(Column.__or__, [text.contains(c) for c in ('"', "\\", "\n", "\r", "\0")])
    escaped = {"\\\\": BACKSLASH, "\\'": SINGLE, '\\"': DOUBLE}
    safe = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), escaped.items(), text)
    marked = F.when(plain, F.replace(text, F.lit("'"), F.lit(QUOTE))).otherwise(F.regexp_replace(safe, STRING, f"{QUOTE}$1$2{QUOTE}"))
    df = df.withColumn("_marked", F.when(~text.rlike(f"[{BACKSLASH}{SINGLE}{DOUBLE}{QUOTE}]"), marked))
    df = df.withColumn("_outside", F.regexp_replace("_marked", f"{QUOTE}[^{QUOTE}]*+{QUOTE}", ""))
    df = df.withColumn("_bare", F.replace("_outside", F.lit("None"), F.lit("")))
    brackets = F.translate("_bare", FILLER, "")
    shape = F.replace(brackets, F.lit("{}"), F.lit("")) == "[]" if many else brackets == "{}"
    shape = shape & F.endswith(F.rtrim(cell), F.lit("]" if many else "}")) & ~F.col("_bare").contains("-0")
    bare = F.replace("_marked", F.lit("None"), F.lit(""))
    only_outside = F.octet_length("_marked") - F.octet_length(bare) == F.octet_length("_outside") - F.octet_length("_bare")
    # Where a string holds the word, every second piece is the inside of a string.
    by_piece = F.array_join(F.transform(F.split("_marked", QUOTE, -1), lambda s, i: F.when(i % 2 == 0, F.replace(s, F.lit("None"), F.lit("null"))).otherwise(s)), QUOTE)
    nulls = F.when(only_outside, F.replace("_marked", F.lit("None"), F.lit("null"))).otherwise(by_piece)
    df = df.withColumn("_nulls", F.when(shape, nulls))
    coded = F.replace(F.replace("_nulls", F.lit("\\a"), F.lit("\\u0007")), F.lit("\\v"), F.lit("\\u000b"))
    coded = F.when(~F.col("_nulls").rlike(KNOWN_ESCAPE), F.regexp_replace(coded, r"\\x(..)", r"\\u00$1"))
    coded = F.when(F.col("_nulls").contains("\\"), coded).otherwise(F.col("_nulls"))
    written = {'"': '\\"', DOUBLE: '\\"', SINGLE: "'", BACKSLASH: "\\\\"}
    odd = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), written.items(), coded)
    body = F.replace(F.when(plain, F.col("_nulls")).otherwise(odd), F.lit(QUOTE), F.lit('"'))
    return df.select(*kept, F.concat(F.lit('{"v":'), body, F.lit("}")).alias(json))


def last_character(text: Column) -> Column:
    """The last character before trailing blanks."""
    return F.substring(F.rtrim(text), -1, 1)


JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowUnquotedControlChars": "true"}


def with_literal(df: DataFrame, alias: str, cell: str, fields: Fields, many: bool = True, native: bool = True) -> DataFrame:
    """Add the typed value of a literal cell: an array of structs, or one struct with ``many=False``.

    Null, empty, ``nan``, ``none``, malformed text and the wrong container give null. List items that are not
    dicts give null elements. ``native=False`` sends every cell to Python; otherwise only those that cannot be read as JSON go there.
    """
    parse, kept = _literal_udf(fields, many), [c for c in df.columns if c != alias]
    if not native:
        return df.select(*kept, parse(F.col(cell)).alias(alias))
    text, null = F.col(cell), (F.lit("None"), F.lit("null"))
    simple = F.when(text.rlike(SIMPLE_LIST if many else SIMPLE_DICT), F.replace(text, *null))
    if many:
        simple = simple.when(text.rlike(MIXED_LIST), F.replace(F.regexp_replace(text, LONE_NUMBER, "$1null"), *null))
    df = df.withColumn("_simple", F.concat(F.lit('{"v":'), F.when(text.endswith("]" if many else "}"), simple), F.lit("}")))
    df = df.withColumn("_hopeless", F.col("_simple").isNull() & last_character(text).rlike(NO_END[many]) & ~text.contains("#"))
    df = df.withColumn("_rest", F.when(F.col("_simple").isNull() & ~F.col("_hopeless"), text))
    df = with_json(df, "_json", "_rest", many).withColumn("_json", F.coalesce("_simple", "_json"))
    df = df.withColumn("_read", F.from_json("_json", f"v {_ddl(fields, many)}, _bad string", JSON_OPTIONS))
    df = df.withColumn("_good", F.coalesce(F.col("_read._bad").isNull() & F.col("_json").isNotNull(), F.lit(False)))
    # Cells that are read already go in as null, so Python only sees the rest.
    df = df.withColumn("_slow", parse(F.when(~F.col("_good") & ~F.col("_hopeless"), F.col(cell))))
    return df.select(*kept, F.when(F.col("_good"), F.col("_read.v")).otherwise(F.col("_slow")).alias(alias))


def with_literal_list(df: DataFrame, alias: str, cell: str, fields: Fields) -> DataFrame:
    """``with_literal`` with an empty array where it would be null."""
    parsed = with_literal(df, alias, cell, fields)
    return parsed.withColumn(alias, F.coalesce(F.col(alias), F.array().cast(_ddl(fields, True))))


def items(df: DataFrame, owner: str, cell: str, fields: Fields, order: Sequence[str]) -> DataFrame:
    """One row per list item: owner as ``movie_id``, the order columns, ``pos`` and the fields."""
    narrow = df.select(F.col(owner).cast("bigint").alias("movie_id"), *order, F.col(cell).alias("_cell"))
    parsed = with_literal(dealt_out(narrow, "movie_id", *order), "_items", "_cell", fields)
    rows = parsed.select("movie_id", *order, F.posexplode("_items").alias("pos", "_item")).filter(F.col("_item").isNotNull())
    return rows.select("movie_id", *order, "pos", *[F.col(f"_item.`{n}`").alias(n) for n in fields])


def id_name_items(df: DataFrame, owner: str, cell: str, order: Sequence[str], key: str = "id") -> DataFrame:
    """Items with an integer key and a name, both present, as (movie_id, order, pos, id, name)."""
    rows = items(df, owner, cell, {key: "long", "name": "string"}, order).withColumnRenamed(key, "id")
    return rows.filter(F.col("id").isNotNull() & F.col("name").isNotNull())


def iso_name_items(df: DataFrame, owner: str, cell: str, order: Sequence[str], key: str) -> DataFrame:
    """Items keyed by a two-letter code (lower-cased, trimmed; others are left out) with a name."""
    rows = items(df, owner, cell, {key: "string", "name": "string"}, order)
    coded = rows.withColumn("id", F.lower(F.trim(key))).drop(key)
    return coded.filter((F.length("id") == 2) & (F.length("name") > 0))


def entities(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct (id, name); the name seen first wins."""
    return first_values(rows, "id", ["name"], [*order, "pos"])


def junction(rows: DataFrame, column: str) -> DataFrame:
    """Distinct (movie_id, entity) pairs."""
    return rows.select("movie_id", F.col("id").alias(column)).distinct()


COLLECTION = {"id": "long", "name": "string", "poster_path": "string", "backdrop_path": "string"}
CAST = {"id": "long", "name": "string", "gender": "long", "profile_path": "string", "order": "long", "character": "string"}
CREW = {"id": "long", "name": "string", "gender": "long", "profile_path": "string", "job": "string", "department": "string"}


def with_collection_id(df: DataFrame, alias: str, cell: str) -> DataFrame:
    """Add the identifier in a collection cell, or null."""
    return with_literal(df, alias, cell, {"id": "long"}, many=False).withColumn(alias, F.col(alias)["id"])


def collections(df: DataFrame, cell: str, order: Sequence[str]) -> DataFrame:
    """Distinct collections (id, name, poster_path, backdrop_path), first seen wins."""
    rows = with_literal(dealt_out(df.select(*order, F.col(cell).alias("_cell")), *order), "_c", "_cell", COLLECTION, many=False).select(*order, "_c.*")
    return first_values(rows.filter(F.col("id").isNotNull()), "id", ["name", "poster_path", "backdrop_path"], order)


def cast_items(df: DataFrame, owner: str, cell: str, order: Sequence[str]) -> DataFrame:
    """Cast entries with a person id and name."""
    rows = items(df, owner, cell, CAST, order)
    return rows.filter(F.col("id").isNotNull() & F.col("name").isNotNull())


def crew_items(df: DataFrame, owner: str, cell: str, order: Sequence[str]) -> DataFrame:
    """Crew entries with a person id, a name and a non-empty job."""
    rows = items(df, owner, cell, CREW, order)
    return rows.filter(F.col("id").isNotNull() & F.col("name").isNotNull() & (F.length("job") > 0))


def cast_table(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(movie_id, person_id, cast_order, character_name), unique by the first three; first wins."""
    named = rows.filter(F.col("order").isNotNull()).select(
        "movie_id", F.col("id").alias("person_id"), F.col("order").alias("cast_order"),
        blank_to_null(F.col("character")).alias("character_name"), *order, "pos",
    )
    key = ["movie_id", "person_id", "cast_order"]
    return first_by_key(named, key, [*order, "pos"]).select(*key, "character_name")


def crew_table(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(movie_id, person_id, job, department), unique by the first three; first wins."""
    named = rows.select(
        "movie_id", F.col("id").alias("person_id"), "job", blank_to_null(F.col("department")).alias("department"),
        *order, "pos",
    )
    key = ["movie_id", "person_id", "job"]
    return first_by_key(named, key, [*order, "pos"]).select(*key, "department")


def people(cast_rows: DataFrame, crew_rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct people as first seen: by row, cast before crew, then position."""
    values = ["name", "gender", "profile_path"]
    seen = [
        rows.select("id", *values, *order, F.lit(rank).alias("_part"), "pos")
        for rank, rows in enumerate((cast_rows, crew_rows))
    ]
    return first_values(seen[0].unionByName(seen[1]), "id", values, [*order, "_part", "pos"])
