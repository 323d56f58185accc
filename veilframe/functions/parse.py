"""Text cleaning and number parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"

# decimal notation with optional exponent; single underscores between digits allowed
FLOAT_PATTERN = (
    r"^[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)"
    r"([eE][+-]?[0-9](_?[0-9])*)?$"
)


def strip(c: Column) -> Column:
    """Remove blanks, tabs and line ends on both sides."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """Null or nothing but blanks; looks no further than the first other character."""
    return ~F.coalesce(c.cast("string").rlike(r"\S"), F.lit(False))


def blank_to_empty(c: Column) -> Column:
    """Stripped text, null as empty text."""
    return F.coalesce(strip(c), F.lit(""))


def float_text(c: Column) -> Column:
    """Text to double, or null when it is not a plain decimal number.

    A cast alone would accept type suffixes such as ``5d`` and the words
    NaN and Infinity; the format guard keeps those out.
    """
    text = strip(c)
    return F.when(
        text.rlike(FLOAT_PATTERN), F.translate(text, "_", "").try_cast("double")
    )


def safe_numeric(c: Column) -> Column:
    """Number from text with ``$``, ``,`` and outer blanks removed, else null."""
    return float_text(F.translate(c, "$,", ""))


def number_or_null(c: Column, data_type: str) -> Column:
    """``safe_numeric`` for text, a plain cast for number and boolean columns."""
    if data_type == "string":
        return safe_numeric(c)
    if data_type == "boolean":
        return c.cast("int").cast("double")
    if data_type in ("float", "double"):
        value = c.cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if data_type in ("tinyint", "smallint", "int", "bigint") or data_type.startswith("decimal"):
        return c.cast("double")
    return safe_numeric(c.cast("string"))


def safe_name(name: str) -> str:
    """A column or table name of lower-case word characters."""
    return re.sub(r"\W+", "_", name.strip()).lower()


def safe_names(names: list[str], reserved: tuple[str, ...] = ("id",)) -> list[str]:
    """Distinct safe names in the given order; clashes get ``_1``, ``_2``, ..."""
    taken = set(reserved)
    result = []
    for name in names:
        base = safe_name(name) or "empty_column"
        candidate, n = base, 0
        while candidate in taken:
            n += 1
            candidate = f"{base}_{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def has_any(name: str, words: list[str]) -> bool:
    """Whether the lower-cased name contains one of the words."""
    lowered = name.lower()
    return any(word in lowered for word in words)


def sql_text(text: str) -> str:
    """A text as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    """A column name as a Spark SQL identifier."""
    return "`" + name.replace("`", "``") + "`"
