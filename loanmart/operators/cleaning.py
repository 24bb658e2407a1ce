"""Raw text rows -> typed, validated rows.

Each table is cleaned in one projection inside codegen; the only shuffle is the full-row dedup, which combines copies on
the map side first, so a group of copies of any size shrinks to one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions import numbers as N, text as X


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def map_columns(df: DataFrame, columns, fn) -> DataFrame:
    """Apply ``fn`` to the named columns in one projection, keeping order."""
    chosen = {c for c in columns if c in df.columns}
    return df.select(*[fn(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fill_numeric_zero(df: DataFrame) -> DataFrame:
    """NULL -> 0 in every numeric column; text and dates keep NULL."""
    return df.na.fill(0)


def drop_null_rows(df: DataFrame, columns=None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def restore_nulls(df: DataFrame, columns) -> DataFrame:
    return map_columns(df, columns, N.nan_to_null)


def clean_columns(raw: DataFrame, types: dict[str, str], on_text=None, on_value=None) -> DataFrame:
    """text rules -> cast -> value rules for every column, as one projection.

    ``on_text`` and ``on_value`` map a column name to functions applied in turn
    before and after the cast.
    """
    df = lower_columns(raw)
    have = set(df.columns)
    out = []
    for name, kind in types.items():
        if name not in have:
            continue
        c = F.col(name)
        for rule in (on_text or {}).get(name, ()):
            c = rule(c)
        c = N.to_type(c, kind)
        for rule in (on_value or {}).get(name, ()):
            c = rule(c)
        out.append(c.alias(name))
    return df.select(*out)


def _attribute_text(name: str):
    if name in S.ATTRIBUTE_UNDERSCORE_COLUMNS:
        yield X.strip_to_null
    if name == "name":
        yield lambda c: X.remove_pattern(c, S.QUOTE_RUN_PATTERN)
    if name == "ssn":
        yield lambda c: X.keep_matching(c, S.SSN_PATTERN)
    if name in S.ATTRIBUTE_UNKNOWN_COLUMNS:
        yield X.fill_unknown


_ATTRIBUTE_TEXT = {name: tuple(_attribute_text(name)) for name in S.ATTRIBUTES}
_ATTRIBUTE_VALUE = {"age": (lambda c: N.null_outside(c, *S.AGE_RANGE),)}


def clean_attributes(raw: DataFrame) -> DataFrame:
    return clean_columns(raw, S.ATTRIBUTES, _ATTRIBUTE_TEXT, _ATTRIBUTE_VALUE)


def clean_clickstream(raw: DataFrame) -> DataFrame:
    return clean_columns(raw, S.CLICKSTREAM)


def _financial_text(name: str):
    if name == "payment_behaviour":
        # shorter than the minimum covers the empty string
        yield lambda c: X.null_if_shorter(c, S.PAYMENT_BEHAVIOUR_MIN_LENGTH)
    else:
        yield X.strip_to_null if name in S.FINANCIAL_UNDERSCORE_COLUMNS else X.blank_to_null
    if name in S.FINANCIAL_UNKNOWN_COLUMNS:
        yield X.fill_unknown


_FINANCIAL_TEXT = {name: tuple(_financial_text(name)) for name, kind in S.FINANCIALS.items() if kind != "date"}
_FINANCIAL_VALUE = {name: (N.null_if_negative,) for name in S.FINANCIAL_NONNEGATIVE_COLUMNS}


def clean_financials(raw: DataFrame) -> DataFrame:
    return clean_columns(raw, S.FINANCIALS, _FINANCIAL_TEXT, _FINANCIAL_VALUE)


def clean_ledger(raw: DataFrame) -> DataFrame:
    """Typed ledger rows; the derived columns are added by ``ledger.with_days_past_due``."""
    return clean_columns(dedup(raw), S.LEDGER)
