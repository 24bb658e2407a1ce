"""Declared schemas and column lists of the four raw tables and the derived marts."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column name -> type of the cleaned tables -----------------
ATTRIBUTES = {
    "customer_id": "string",
    "name": "string",
    "age": "int",
    "ssn": "string",
    "occupation": "string",
    "snapshot_date": "date",
}

CLICKSTREAM = {
    **{f"fe_{i}": "int" for i in range(1, 21)},
    "customer_id": "string",
    "snapshot_date": "date",
}

FINANCIALS = {
    "customer_id": "string",
    "annual_income": "double",
    "monthly_inhand_salary": "double",
    "num_bank_accounts": "int",
    "num_credit_card": "int",
    "interest_rate": "int",
    "num_of_loan": "int",
    "type_of_loan": "string",
    "delay_from_due_date": "int",
    "num_of_delayed_payment": "int",
    "changed_credit_limit": "double",
    "num_credit_inquiries": "int",
    "credit_mix": "string",
    "outstanding_debt": "double",
    "credit_utilization_ratio": "double",
    "credit_history_age": "string",
    "payment_of_min_amount": "string",
    "total_emi_per_month": "double",
    "amount_invested_monthly": "double",
    "payment_behaviour": "string",
    "monthly_balance": "double",
    "snapshot_date": "date",
}

LEDGER = {
    "loan_id": "string",
    "customer_id": "string",
    "loan_start_date": "date",
    "tenure": "int",
    "installment_num": "int",
    "loan_amt": "double",
    "due_amt": "double",
    "paid_amt": "double",
    "overdue_amt": "double",
    "balance": "double",
    "snapshot_date": "date",
}

# --- fixed values: which cleaning step touches which column -------------------
ATTRIBUTE_UNDERSCORE_COLUMNS = ("name", "age", "occupation")
ATTRIBUTE_UNKNOWN_COLUMNS = ("ssn", "occupation")
AGE_RANGE = (1, 150)
SSN_PATTERN = r"^\d{3}-\d{2}-\d{4}$"
QUOTE_RUN_PATTERN = r'"{3,}'

FINANCIAL_UNDERSCORE_COLUMNS = (
    "annual_income",
    "monthly_inhand_salary",
    "num_bank_accounts",
    "num_credit_card",
    "interest_rate",
    "num_of_loan",
    "delay_from_due_date",
    "num_of_delayed_payment",
    "changed_credit_limit",
    "num_credit_inquiries",
    "outstanding_debt",
    "credit_utilization_ratio",
    "total_emi_per_month",
    "amount_invested_monthly",
    "monthly_balance",
    "credit_mix",
)
FINANCIAL_NONNEGATIVE_COLUMNS = (
    "num_of_loan",
    "num_credit_card",
    "num_bank_accounts",
    "delay_from_due_date",
    "num_of_delayed_payment",
)
FINANCIAL_UNKNOWN_COLUMNS = ("credit_mix", "payment_behaviour", "type_of_loan")
PAYMENT_BEHAVIOUR_MIN_LENGTH = 10

# --- fixed values: loan kinds that become 0/1 flags ---------------------------
LOAN_TYPES = (
    "Payday Loan",
    "Personal Loan",
    "Home Equity Loan",
    "Credit-Builder Loan",
    "Mortgage Loan",
    "Student Loan",
    "Debt Consolidation Loan",
    "Auto Loan",
)
LOAN_TYPE_NOISE = ("", "Unknown", "Not Specified")

LABEL_DPD = 30
LABEL_MOB = 6
LABEL_COLUMNS = ("loan_id", "customer_id", "loan_start_date", "label", "label_def", "snapshot_date")

# --- fixed values: encoder column lists ---------------------------------------
CAP_COLUMNS = (
    "annual_income",
    "monthly_inhand_salary",
    "repayment_ability",
    "num_bank_accounts",
    "num_credit_card",
    "interest_rate",
    "num_of_loan",
    "delay_from_due_date",
    "num_of_delayed_payment",
    "changed_credit_limit",
    "num_credit_inquiries",
    "outstanding_debt",
    "credit_utilization_ratio",
    "total_emi_per_month",
    "amount_invested_monthly",
    "monthly_balance",
)
CAP_PROBABILITY = 0.97
FILL_COLUMNS = ("age", *CAP_COLUMNS)
# the derived ratios stay NULL after the listed fills; a model cannot take that
EXTRA_FILL_COLUMNS = ("credit_history_age", "investment_income_ratio", "income_per_card")
ONE_HOT_COLUMNS = ("occupation", "payment_of_min_amount", "payment_behaviour")
ORDINAL_COLUMNS = ("credit_mix",)
SCALED_COLUMNS = (
    "annual_income",
    "repayment_ability",
    "monthly_inhand_salary",
    "outstanding_debt",
    "amount_invested_monthly",
    "monthly_balance",
)
ENCODING_SENTINELS = {"payment_of_min_amount": "NM", "credit_mix": "Unknown"}
ID_COLUMNS = (
    "customer_id",
    "loan_start_date",
    "feature_snapshot_date",
    "loan_id",
    "label_def",
    "label_snapshot_date",
)

TEST_SHARE = 0.1
VALID_SHARE = 0.2
SPLIT_SEED = 42


def struct(columns: dict[str, str]) -> T.StructType:
    """The cleaned schema as a Spark struct."""
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    return T.StructType.fromDDL(ddl)


def raw_struct(names) -> T.StructType:
    """All-string schema of a raw file with these header names."""
    return T.StructType([T.StructField(name, T.StringType(), True) for name in names])
