"""Numeric expressions: safe casts, range guards and the derived ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_type(c: Column, kind: str) -> Column:
    """Cast dirty text: unreadable values and NaN become NULL, '7.0' and '3.9' truncate to int."""
    if kind == "int":
        return c.try_cast("double").try_cast("int")
    if kind == "double":
        return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    if kind == "string":
        return c.cast("string")
    return c.try_cast(kind)


def null_if_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def null_outside(c: Column, low, high) -> Column:
    return F.when(c.between(low, high), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def cap_at(c: Column, cap) -> Column:
    """One-sided cap. ``least`` would turn NULL into the cap, so it is not used."""
    return F.when(c > F.lit(cap), F.lit(cap)).otherwise(c)


def ratio_or(numerator: Column, denominator: Column, when_zero: Column) -> Column:
    """numerator / denominator, and ``when_zero`` for a zero denominator."""
    return F.when(denominator == 0, when_zero).otherwise(numerator / denominator)


def investment_income_ratio(invested: Column, salary: Column) -> Column:
    return ratio_or(invested, salary, F.lit(1.0))


def income_per_card(salary: Column, cards: Column) -> Column:
    return ratio_or(salary, cards, salary)


def repayment_ability(salary: Column, emi: Column) -> Column:
    return salary - emi


def share(part: Column, whole: Column) -> Column:
    """part / whole; NULL on an empty table instead of an error."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def standardise(c: Column, mean: float | None, std: float | None) -> Column:
    """(x - mean) / std with a constant column divided by 1."""
    if mean is None:
        return c.cast("double")
    return (c - F.lit(float(mean))) / F.lit(float(std) if std else 1.0)
