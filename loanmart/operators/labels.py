"""Default labels from the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S


def default_label(dpd: Column, threshold: int = S.LABEL_DPD) -> Column:
    """1 at or beyond the threshold; 0 below it and for an unknown dpd."""
    return F.when(dpd >= threshold, 1).otherwise(0)


def label_definition(dpd: int = S.LABEL_DPD, mob: int = S.LABEL_MOB) -> str:
    return f"{dpd}dpd_{mob}mob"


def at_month_on_book(ledger: DataFrame, mob: int = S.LABEL_MOB) -> DataFrame:
    return ledger.where(F.col("mob") == mob)


def default_labels(ledger: DataFrame, dpd: int = S.LABEL_DPD, mob: int = S.LABEL_MOB) -> DataFrame:
    """Label rows of loans that reached ``mob``; a narrow plan without shuffle."""
    return (
        at_month_on_book(ledger, mob)
        .withColumn("label", default_label(F.col("dpd"), dpd))
        .withColumn("label_def", F.lit(label_definition(dpd, mob)))
        .select(*S.LABEL_COLUMNS)
    )
