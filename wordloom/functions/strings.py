"""Functions of text columns, null where the text is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .separators import SEP

_REST = 1 << 30


def is_capitalized(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^\p{javaUpperCase}"))


def is_upper(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^\p{javaUpperCase}+\z"))


def has_upper(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\p{javaUpperCase}"))


def capitalize(text: Column) -> Column:
    """The first character in upper case, where that is one character."""
    first = F.upper(F.substring(text, 1, 1))
    return F.when(F.length(first) == 1, F.concat(first, F.substring(text, 2, _REST))).otherwise(text)


def uncapitalize(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, _REST))


def is_blank(text: Column) -> Column:
    """Null counts as blank."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", " "))) == 0


def same(a: Column, b: Column) -> Column:
    """Equal, or both null."""
    return a.eqNullSafe(b)


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a).eqNullSafe(F.lower(b))


def until_separator(text: Column) -> Column:
    """The run of other characters that a text begins with."""
    return F.regexp_extract(text, f"^[^{SEP}]*", 0)


def since_separator(text: Column) -> Column:
    """The run of other characters that a text ends with."""
    return F.regexp_extract(text, rf"[^{SEP}]*\z", 0)


def position(needle: Column, text: Column, start: Column) -> Column:
    """Index from 0 of needle in text at `start` or later, -1 if none; an empty needle is at start."""
    return F.when(needle == "", F.least(start, F.length(text))).otherwise(F.position(needle, text, start + 1) - 1)


def insertion(display: Column, prefix: Column) -> tuple[Column, Column]:
    """What to insert for a word, given what is typed of it, and how many typed characters go first."""
    goes_on = F.startswith(display, prefix)
    rest = F.when(goes_on, F.substring(display, F.length(prefix) + 1, F.lit(_REST))).otherwise(display)
    return F.when(prefix.isNull(), display).otherwise(rest), F.when(prefix.isNull() | goes_on, 0).otherwise(F.length(prefix))
