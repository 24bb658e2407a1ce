"""Joins (JN) and set operations, ordering, limits, sampling (SO)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import drift as D, joins as J, quality as Q, splits as Sp
from ..sources import snapshots as Sn
from .base import FEATURE_COLUMNS, Marts, OOT_DATE, SPLIT_KEYS, query, r

_DOUBLES = {
    "annual_income",
    "monthly_inhand_salary",
    "changed_credit_limit",
    "outstanding_debt",
    "credit_utilization_ratio",
    "credit_history_age",
    "total_emi_per_month",
    "amount_invested_monthly",
    "monthly_balance",
    "investment_income_ratio",
    "income_per_card",
    "repayment_ability",
}


def feature_output(names=FEATURE_COLUMNS) -> str:
    """Select list of feature columns in the shared output form."""
    out = []
    for c in names:
        if c in _DOUBLES:
            out.append(f"{r(c)} as {c}")
        elif c in ("snapshot_date", "loan_start_date", "feature_snapshot_date", "label_snapshot_date"):
            out.append(f"cast({c} as varchar) as {c}")
        else:
            out.append(f'"{c}"')
    return ", ".join(out)


@query(
    "jn1_full_outer_features",
    f"select customer_id, cast(snapshot_date as varchar) as snapshot_date, age, occupation, {r('annual_income')} as annual_income, credit_mix from g_join",
)
def jn1(t: Marts) -> DataFrame:
    return J.features_by_snapshot(t.att, t.fin).select(
        "customer_id", "snapshot_date", "age", "occupation", "annual_income", "credit_mix"
    )


@query("feature_store", f"select {feature_output()} from g_feat")
def feature_store(t: Marts) -> DataFrame:
    return t.features


_JN2 = """select f.customer_id, cast(f.snapshot_date as varchar) as loan_start_date, cast(f.snapshot_date as varchar) as feature_snapshot_date,
 f.credit_mix, l.loan_id, l.label, cast(l.snapshot_date as varchar) as label_snapshot_date
 from g_feat f {how} join g_lbl l on f.customer_id = l.customer_id and f.snapshot_date = l.loan_start_date {where}"""
_JN2_COLUMNS = (
    "customer_id",
    "loan_start_date",
    "feature_snapshot_date",
    "credit_mix",
    "loan_id",
    "label",
    "label_snapshot_date",
)


@query("jn2_features_left_labels", _JN2.format(how="left", where=""))
def jn2(t: Marts) -> DataFrame:
    return J.attach_labels(t.features, t.gold_labels).select(*_JN2_COLUMNS)


@query("jn3_features_inner_labels", _JN2.format(how="inner", where=""))
def jn3(t: Marts) -> DataFrame:
    return t.labelled.select(*_JN2_COLUMNS)


@query(
    "jn4_unlabelled_features",
    _JN2.format(how="left", where="where l.loan_id is null").replace(
        "l.loan_id, l.label, cast(l.snapshot_date as varchar) as label_snapshot_date",
        f"{r('f.income_per_card')} as income_per_card",
    ),
)
def jn4(t: Marts) -> DataFrame:
    return J.unlabelled_features(t.features, t.gold_labels).select(
        "customer_id", "loan_start_date", "feature_snapshot_date", "credit_mix", "income_per_card"
    )


@query(
    "jn5_labels_with_predictions",
    """select l.loan_id, l.customer_id, cast(l.loan_start_date as varchar) as loan_start_date, l.label, p.prediction from g_lbl l join
 (select customer_id, snapshot_date as loan_start_date, case when total_emi_per_month > 250 then 1 else 0 end as prediction from c_fin) p
 on l.customer_id = p.customer_id and l.loan_start_date = p.loan_start_date""",
)
def jn5(t: Marts) -> DataFrame:
    predictions = t.fin.select(
        "customer_id",
        F.col("snapshot_date").alias("loan_start_date"),
        F.when(F.col("total_emi_per_month") > 250, 1).otherwise(0).alias("prediction"),
    )
    return J.labels_with_predictions(t.gold_labels, predictions).select(
        "loan_id", "customer_id", "loan_start_date", "label", "prediction"
    )


@query(
    "jn6_same_snapshot_labels",
    """select f.customer_id, cast(f.snapshot_date as varchar) as snapshot_date, f.credit_mix, l.loan_id, l.label
 from c_fin f left join g_lbl l on f.customer_id = l.customer_id and f.snapshot_date = l.snapshot_date""",
)
def jn6(t: Marts) -> DataFrame:
    features = t.fin.select("customer_id", "snapshot_date", "credit_mix")
    return J.snapshot_features_with_labels(features, t.gold_labels).select(
        "customer_id", "snapshot_date", "credit_mix", "loan_id", "label"
    )


@query(
    "jn7_results_beside_ids",
    """select customer_id, cast(snapshot_date as varchar) as loan_start_date, case when credit_mix = 'Bad' then 1 else 0 end as prediction,
 case when credit_mix = 'Bad' then 1.0e0 else 0.0e0 end as credit_mix_bad from c_fin""",
)
def jn7(t: Marts) -> DataFrame:
    bad = F.col("credit_mix") == "Bad"
    return t.fin.select(
        "customer_id",
        F.col("snapshot_date").alias("loan_start_date"),
        bad.cast("int").alias("prediction"),
        bad.cast("double").alias("credit_mix_bad"),
    )


# --- set operations, ordering, limits, sampling ------------------------------------


@query(
    "so1_union_history",
    "select customer_id, cast(snapshot_date as varchar) as snapshot_date, credit_mix from fx_fin",
)
def so1(t: Marts) -> DataFrame:
    table = t.fx_fin.select("customer_id", "snapshot_date", "credit_mix")
    last = str(table.agg(F.max("snapshot_date")).first()[0])
    return Sn.append_month(Sn.before(table, last), Sn.slice_month(table, last))


@query(
    "so2_train_and_valid",
    "select label, count(*) as n from g_split where split <> 'test' group by label",
)
def so2(t: Marts) -> DataFrame:
    rows = t.stored(t.labelled.select(*SPLIT_KEYS, "label", "label_snapshot_date"))
    split = Sp.assign_splits(rows, OOT_DATE, SPLIT_KEYS)
    return Sp.train_and_valid(split).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "so3_distinct_rows_and_keys",
    """select (select count(*) from fx_att) as rows, (select count(*) from (select distinct customer_id, name, age, ssn, occupation from fx_att)) as distinct_rows,
 (select count(distinct customer_id) from fx_att) as distinct_customer_id, (select count(distinct ssn) from fx_att) as distinct_ssn""",
)
def so3(t: Marts) -> DataFrame:
    # copies apart from the month collapse first; the key counts then run on the small rest
    rows = t.fx_att.groupBy("customer_id", "name", "age", "ssn", "occupation").agg(
        F.count(F.lit(1)).alias("copies")
    )
    return rows.agg(
        F.sum("copies").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_distinct("customer_id").alias("distinct_customer_id"),
        F.count_distinct("ssn").alias("distinct_ssn"),
    )


@query(
    "so4_order_by",
    "select customer_id, count(*) as n from fx_lms group by customer_id order by n desc, customer_id",
)
def so4(t: Marts) -> DataFrame:
    return Q.value_counts(t.fx_lms, "customer_id").orderBy(F.col("n").desc(), "customer_id")


@query(
    "so5_limit",
    "select customer_id, cast(snapshot_date as varchar) as snapshot_date, credit_mix from c_fin order by customer_id, snapshot_date, annual_income desc nulls last limit 10",
)
def so5(t: Marts) -> DataFrame:
    ordered = t.fin.orderBy("customer_id", "snapshot_date", F.col("annual_income").desc_nulls_last())
    return ordered.limit(10).select("customer_id", "snapshot_date", "credit_mix")


@query(
    "so6_sample_rows",
    "select loan_id, label from (select loan_id, max(label) as label from g_lbl group by loan_id) order by md5(concat(loan_id, '42')), loan_id limit 10",
)
def so6(t: Marts) -> DataFrame:
    loans = t.gold_labels.groupBy("loan_id").agg(F.max("label").alias("label"))
    return Q.sample_rows(loans, "loan_id", 10)


@query(
    "so7_top_features",
    f"""select customer_id, {r('score')} as score from (select customer_id, sum(due_amt) as score from fx_lms group by customer_id)
 order by score desc, customer_id limit 5""",
)
def so7(t: Marts) -> DataFrame:
    totals = t.fx_lms.groupBy("customer_id").agg(F.sum("due_amt").alias("score"))
    return Q.top_rows(totals, "score", 5, ("customer_id",))


@query(
    "so8_last_records",
    """select cast(snapshot_date as varchar) as date, count(*) as n from g_lbl group by snapshot_date order by snapshot_date desc limit 12""",
)
def so8(t: Marts) -> DataFrame:
    records = t.gold_labels.groupBy(F.col("snapshot_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return D.last_records(records, 12)
