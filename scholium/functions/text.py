"""Column functions on text; null, empty and white-space rules are those of Python strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"


def strip(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(column, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def has_text(column: Column) -> Column:
    """True where a string holds anything but white space, which the first such character shows."""
    return F.coalesce(column.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def filled(column: Column) -> Column:
    """True where a string is neither null nor empty."""
    return F.coalesce(column != "", F.lit(False))


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def first_filled(*columns: Column, default: str | None = None) -> Column:
    rest = [] if default is None else [F.lit(default)]
    return F.coalesce(*(blank_to_null(c) for c in columns), *rest)


def contains_any_case(column: Column, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle.lower()))


def matching_terms(blob: Column, terms: list[str]) -> Column:
    """The terms that the text contains, in the order of the lexicon."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(blob, t)) if terms else F.array().cast("array<string>")


def snippet(column: Column, length: int = 200) -> Column:
    text = F.coalesce(column, F.lit(""))
    return F.concat(F.substring(text, 1, length), F.when(F.length(text) > length, "...").otherwise(""))
