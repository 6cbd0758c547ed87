"""Text normalisation for cleaning and for accent-, case- and hyphen-blind search."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Letters without a canonical decomposition, and letters that unfold to several.
UNDECOMPOSED = {
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h",
    "ı": "i", "Ł": "L", "ł": "l", "Ŧ": "T", "ŧ": "t", "Ŋ": "N", "ŋ": "n", "ĸ": "q",
}
UNFOLDED = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH",
    "ĳ": "ij", "Ĳ": "IJ", "ŉ": "'n", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
}
# Latin, Greek and the one accented Cyrillic pair; everything else passes unchanged.
ACCENTED_RANGES = ((0x00C0, 0x024F), (0x0370, 0x03FF), (0x1E00, 0x1FFF), (0x0401, 0x0401), (0x0451, 0x0451))


def _accent_table() -> tuple[str, str]:
    """Each accented letter and its base letter, from the canonical decompositions of Unicode."""
    pairs = dict(UNDECOMPOSED)
    for first, last in ACCENTED_RANGES:
        for code in range(first, last + 1):
            letter = chr(code)
            base = unicodedata.normalize("NFD", letter)[0]
            if base != letter and base.isalpha():
                pairs[letter] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accent_table()


def unaccent(text: Column) -> Column:
    """Strip accents with built-in expressions only; null stays null."""
    plain = F.translate(text, ACCENTED, PLAIN)
    for letter, letters in UNFOLDED.items():
        plain = F.replace(plain, F.lit(letter), F.lit(letters))
    return plain


def search_form(text: Column) -> Column:
    """Accent-free lower case with hyphens as spaces: the form titles and queries are compared in."""
    return F.replace(F.lower(unaccent(text)), F.lit("-"), F.lit(" "))


def register_unaccent(spark: SparkSession, name: str = "unaccent") -> None:
    """Make accent stripping callable from SQL as a native (inlined) function."""
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    body = f"translate(x, '{quote(ACCENTED)}', '{quote(PLAIN)}')"
    for letter, letters in UNFOLDED.items():
        body = f"replace({body}, '{letter}', '{quote(letters)}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")


def like_text(query: Column, literal: bool = False) -> Column:
    """The user's query as LIKE text: ``%`` and ``_`` stay wildcards unless ``literal``.

    A backslash before an ordinary character means that character, so it is dropped here; Spark
    would refuse it.
    """
    if literal:
        return F.regexp_replace(query, r"([\\%_])", r"\\$1")
    return F.regexp_replace(query, r"(\\[%_\\])|\\([^%_\\])", "$1$2")


def like_tokens(source: str) -> list[tuple[str, bool]]:
    """The characters of a LIKE pattern, each with whether it is a wildcard."""
    tokens = re.findall(r"\\.|[^\\]|\\$", source, re.DOTALL)
    return [(t, True) if t in ("%", "_") else (t[1:] if t[0] == "\\" and len(t) > 1 else t, False) for t in tokens]


def like_fragments(source: str) -> list[str]:
    """The literal runs of a LIKE pattern."""
    runs = [""]
    for token, wild in like_tokens(source):
        if wild:
            runs.append("")
        else:
            runs[-1] += token
    return [run for run in runs if run]


def like_regex(source: str) -> re.Pattern[str]:
    """The LIKE pattern as a regular expression for a whole text."""
    return re.compile("".join({"%": ".*", "_": "."}[t] if wild else re.escape(t) for t, wild in like_tokens(source)), re.DOTALL)


def one_line(text: Column) -> Column:
    """Collapse every run of Unicode white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def zero_padded_id(number: Column, prefix: str = "tt", width: int = 7) -> Column:
    """``tt0114709`` from 114709; longer numbers keep all digits and null stays null."""
    return F.when(number.isNotNull(), F.format_string(f"{prefix}%0{width}d", number.cast("bigint")))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)
