"""Lenient text-to-value coercion: what cannot be read becomes null and never fails the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number spellings accepted, and the calendar range of a nanosecond timestamp.
NUMBER = r"^[ \t\r\n\f\x0B]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))[ \t\r\n\f\x0B]*$"
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
FIRST_DATE = "1677-09-22"
LAST_DATE = "2262-04-11"


def to_number(text: Column) -> Column:
    """Double for numeric text, null otherwise; ``NaN`` and Java suffixes such as ``1d`` are null.

    The pattern decides, because a bare ``try_cast`` would accept more than digits and exponents.
    """
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_of(column: Column, dtype: str) -> Column:
    """``to_number`` for text, a NaN-free double for columns that are numeric already."""
    if dtype == "string":
        return to_number(column)
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def whole_of(column: Column, dtype: str, label: str) -> Column:
    """Bigint of a numeric column or numeric text; plain digits keep their full precision."""
    if dtype != "string":
        return whole(number_of(column, dtype), label)
    digits = F.when(column.rlike(r"^[ \t]*[+-]?[0-9]+[ \t]*$"), column.try_cast("bigint"))
    return F.coalesce(digits, whole(to_number(column), label))


def whole(number: Column, label: str) -> Column:
    """Bigint of a whole double; a fractional or infinite value raises, null stays null."""
    text = F.format_string(f"column {label} holds a value that is not a whole number: %s", number.cast("string"))
    ok = number.isNull() | ((number == F.floor(number)) & (F.abs(number) < F.lit(9.2e18)))
    return F.when(ok, number.try_cast("bigint")).otherwise(F.raise_error(text).cast("bigint"))


def to_day(text: Column) -> Column:
    """Date for ``year-month-day`` text within the supported calendar, null otherwise."""
    day = F.when(text.rlike(ISO_DATE), F.try_to_date(text, "yyyy-M-d"))
    return F.when(day.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date")), day)


def day_of(column: Column, dtype: str) -> Column:
    """``to_day`` for text, a plain date for columns that hold dates or timestamps already."""
    return to_day(column) if dtype == "string" else column.cast("date")


def is_true(column: Column) -> Column:
    """Whether text or boolean reads as true (``true`` or ``1``, any case, outer blanks ignored)."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin("true", "1"), F.lit(False))
