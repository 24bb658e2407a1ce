"""Month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_of(c: Column) -> Column:
    return F.trunc(c.cast("date"), "month")


def previous_month(c: Column) -> Column:
    return F.add_months(c, -1)


def is_first_of_month(c: Column) -> Column:
    return F.dayofmonth(c) == 1


def month_sequence(start: Column, end: Column) -> Column:
    """Array of the months start..end; explode it for one row per month."""
    return F.sequence(start, end, F.expr("interval 1 month"))
