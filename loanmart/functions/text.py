"""Cleaning expressions on strings. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed value: text form of a duration
DURATION_PATTERN = r"^(\d+)\s+Years?\s+and\s+(\d+)\s+Months?"


def strip_to_null(c: Column, chars: str = "_") -> Column:
    """Remove every occurrence of ``chars``; an empty remainder becomes NULL."""
    return F.nullif(F.replace(c, F.lit(chars), F.lit("")), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def remove_pattern(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def keep_matching(c: Column, pattern: str) -> Column:
    """The value where it matches ``pattern``, NULL elsewhere."""
    return F.when(c.rlike(pattern), c)


def null_if_shorter(c: Column, length: int) -> Column:
    return F.when(F.length(c) >= length, c)


def fill_unknown(c: Column, word: str = "Unknown") -> Column:
    return F.coalesce(c, F.lit(word))


def sentinel_to_null(c: Column, sentinel: str) -> Column:
    return F.nullif(c, F.lit(sentinel))


def duration_years(c: Column) -> Column:
    """'22 Years and 1 Months' -> 22 + 1/12; other text -> 0; NULL -> NULL."""
    years = F.regexp_extract(c, DURATION_PATTERN, 1).try_cast("double")
    months = F.regexp_extract(c, DURATION_PATTERN, 2).try_cast("double")
    return F.when(c.isNotNull(), F.coalesce(years + months / 12.0, F.lit(0.0)))


def snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def loan_tokens(c: Column) -> Column:
    """Array of the trimmed items of 'A, B, and C'."""
    return F.transform(F.split(c, r",\s*and\s|,\s|\sand\s"), lambda item: F.trim(item))
