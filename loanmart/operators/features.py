"""Wide feature rows per (customer_id, snapshot_date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions import numbers as N, text as X
from .joins import features_by_snapshot


def loan_type_flags(df: DataFrame, column: str = "type_of_loan", kinds=S.LOAN_TYPES) -> DataFrame:
    """Replace a comma list by one 0/1 column per kind; NULL counts as none."""
    flags = {
        f"{column}_{X.snake(kind)}": F.when(F.col(column).contains(kind), 1).otherwise(0)
        for kind in kinds
    }
    return df.withColumns(flags).drop(column)


def loan_vocabulary(df: DataFrame, column: str = "type_of_loan", noise=S.LOAN_TYPE_NOISE) -> DataFrame:
    """Distinct items of the comma lists, combined on the map side, never collected."""
    tokens = df.select(F.explode(X.loan_tokens(F.col(column))).alias("loan_type"))
    return tokens.where(~F.col("loan_type").isin(*noise)).distinct()


def derived_ratios(df: DataFrame) -> DataFrame:
    salary, emi = F.col("monthly_inhand_salary"), F.col("total_emi_per_month")
    return df.withColumns(
        {
            "investment_income_ratio": N.investment_income_ratio(F.col("amount_invested_monthly"), salary),
            "income_per_card": N.income_per_card(salary, F.col("num_credit_card")),
            "repayment_ability": N.repayment_ability(salary, emi),
        }
    )


def build_features(attributes: DataFrame, financials: DataFrame) -> DataFrame:
    # unused identifiers are dropped before the join so they are never shuffled
    joined = features_by_snapshot(attributes.drop("name", "ssn"), financials)
    joined = joined.withColumn("credit_history_age", X.duration_years(F.col("credit_history_age")))
    return derived_ratios(loan_type_flags(joined))
