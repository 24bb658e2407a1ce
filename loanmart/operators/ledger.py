"""Loan ledger: month on book, missed installments and days past due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .cleaning import fill_numeric_zero


def month_on_book(installment_num: Column) -> Column:
    return installment_num.cast("int")


def installments_missed(overdue: Column, due: Column) -> Column:
    return F.when(due == 0, 0).otherwise(F.ceil(overdue / due).cast("int"))


def first_missed_date(snapshot_date: Column, missed: Column) -> Column:
    return F.when(missed > 0, F.add_months(snapshot_date, -missed))


def days_past_due(overdue: Column, snapshot_date: Column, first_missed: Column) -> Column:
    """NULL where money is overdue although nothing was due (no missed date exists)."""
    return F.when(overdue > 0, F.datediff(snapshot_date, first_missed)).otherwise(0)


def with_days_past_due(ledger: DataFrame) -> DataFrame:
    """Add mob, installments_missed, first_missed_date and dpd.

    Numeric NULLs of the whole row become 0 after installments_missed is known.
    """
    df = ledger.withColumns(
        {
            "mob": month_on_book(F.col("installment_num")),
            "installments_missed": installments_missed(F.col("overdue_amt"), F.col("due_amt")),
        }
    )
    df = fill_numeric_zero(df)
    df = df.withColumn(
        "first_missed_date", first_missed_date(F.col("snapshot_date"), F.col("installments_missed"))
    )
    return df.withColumn(
        "dpd", days_past_due(F.col("overdue_amt"), F.col("snapshot_date"), F.col("first_missed_date"))
    )
