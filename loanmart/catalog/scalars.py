"""Scalar functions and derived features (SC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as Dt, numbers as N, text as X
from ..operators import features as Fe, ledger as Lg, labels as L
from .base import DURATION_SQL, FLAG_NAMES, Marts, query, r

_ROW = ("loan_id", "installment_num", "snapshot_date")
_ROW_SQL = "loan_id, installment_num, cast(snapshot_date as varchar) as snapshot_date"


@query("sc1_month_on_book", "select loan_id, cast(snapshot_date as varchar) as snapshot_date, installment_num as mob from fx_lms")
def sc1(t: Marts) -> DataFrame:
    return t.fx_lms.select("loan_id", "snapshot_date", Lg.month_on_book(F.col("installment_num")).alias("mob"))


@query(
    "sc2_installments_missed",
    f"""select {_ROW_SQL}, case when due_amt = 0 then 0 else cast(ceil(overdue_amt / due_amt) as integer) end as installments_missed from fx_lms""",
)
def sc2(t: Marts) -> DataFrame:
    missed = Lg.installments_missed(F.col("overdue_amt"), F.col("due_amt"))
    return t.fx_lms.select(*_ROW, missed.alias("installments_missed"))


@query(
    "sc3_first_missed_date",
    f"select {_ROW_SQL}, installments_missed, cast(first_missed_date as varchar) as first_missed_date from c_lms",
)
def sc3(t: Marts) -> DataFrame:
    return t.ledger.select(*_ROW, "installments_missed", "first_missed_date")


@query("sc4_days_past_due", f"select {_ROW_SQL}, dpd from c_lms")
def sc4(t: Marts) -> DataFrame:
    return t.ledger.select(*_ROW, "dpd")


@query(
    "sc5_default_label",
    f"select {_ROW_SQL}, case when dpd >= 30 then 1 else 0 end as label_30, case when dpd >= 60 then 1 else 0 end as label_60 from c_lms",
)
def sc5(t: Marts) -> DataFrame:
    return t.ledger.select(
        *_ROW,
        L.default_label(F.col("dpd")).alias("label_30"),
        L.default_label(F.col("dpd"), 60).alias("label_60"),
    )


@query(
    "sc6_duration_years",
    f"select customer_id, cast(snapshot_date as varchar) as snapshot_date, {r(DURATION_SQL)} as years from c_fin",
)
def sc6(t: Marts) -> DataFrame:
    return t.fin.select("customer_id", "snapshot_date", X.duration_years(F.col("credit_history_age")).alias("years"))


_FLAG_SQL = ", ".join(
    f"case when contains(type_of_loan, '{k}') then 1 else 0 end as \"{n}\""
    for k, n in zip(Fe.S.LOAN_TYPES, FLAG_NAMES)
)


@query(
    "sc7_loan_type_flags",
    f"select customer_id, cast(snapshot_date as varchar) as snapshot_date, {_FLAG_SQL} from c_fin",
)
def sc7(t: Marts) -> DataFrame:
    return Fe.loan_type_flags(t.fin.select("customer_id", "snapshot_date", "type_of_loan"))


_FIN_ROW = "customer_id, cast(snapshot_date as varchar) as snapshot_date"


@query(
    "sc8_investment_income_ratio",
    f"""select {_FIN_ROW}, {r('case when monthly_inhand_salary = 0 then 1.0e0 else amount_invested_monthly / monthly_inhand_salary end')}
 as investment_income_ratio from c_fin""",
)
def sc8(t: Marts) -> DataFrame:
    value = N.investment_income_ratio(F.col("amount_invested_monthly"), F.col("monthly_inhand_salary"))
    return t.fin.select("customer_id", "snapshot_date", value.alias("investment_income_ratio"))


@query(
    "sc9_income_per_card",
    f"""select {_FIN_ROW}, {r('case when num_credit_card = 0 then monthly_inhand_salary else monthly_inhand_salary / num_credit_card end')}
 as income_per_card from c_fin""",
)
def sc9(t: Marts) -> DataFrame:
    value = N.income_per_card(F.col("monthly_inhand_salary"), F.col("num_credit_card"))
    return t.fin.select("customer_id", "snapshot_date", value.alias("income_per_card"))


@query(
    "sc10_repayment_ability",
    f"select {_FIN_ROW}, {r('monthly_inhand_salary - total_emi_per_month')} as repayment_ability from c_fin",
)
def sc10(t: Marts) -> DataFrame:
    value = N.repayment_ability(F.col("monthly_inhand_salary"), F.col("total_emi_per_month"))
    return t.fin.select("customer_id", "snapshot_date", value.alias("repayment_ability"))


@query(
    "sc11_month_sequence",
    """select cast(m as varchar) as snapshot_date, coalesce(n, 0) as rows from
 (select cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as m from
  (select cast(min(snapshot_date) as timestamp) as lo, cast(max(snapshot_date) as timestamp) as hi from fx_lms))
 left join (select snapshot_date, count(*) as n from fx_lms group by snapshot_date) on m = snapshot_date""",
)
def sc11(t: Marts) -> DataFrame:
    months = t.fx_lms.agg(
        F.explode(Dt.month_sequence(F.min("snapshot_date"), F.max("snapshot_date"))).alias("snapshot_date")
    )
    counts = t.fx_lms.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("rows"))
    return months.join(counts, "snapshot_date", "left").fillna(0, ["rows"])


@query(
    "sc12_previous_month",
    """select cast(snapshot_date as varchar) as snapshot_date, cast(cast(snapshot_date - interval 1 month as date) as varchar) as previous_month,
 count(*) as n from fx_lms group by snapshot_date""",
)
def sc12(t: Marts) -> DataFrame:
    return t.fx_lms.groupBy(
        "snapshot_date", Dt.previous_month(F.col("snapshot_date")).alias("previous_month")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sc13_percent_share",
    f"""select cast(snapshot_date as varchar) as snapshot_date, count(*) as label_count, count(*) filter (where label = 1) as label_1,
 {r('count(*) filter (where label = 1) / cast(count(*) as double)')} as labels_percent from g_lbl group by snapshot_date""",
)
def sc13(t: Marts) -> DataFrame:
    counts = t.gold_labels.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("label_count"), F.count_if(F.col("label") == 1).alias("label_1")
    )
    return counts.withColumn("labels_percent", N.share(F.col("label_1"), F.col("label_count")))
