"""Filters (FL), projections (PR) and cleaning (CL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions import numbers as N, text as X
from ..operators import cleaning as C, encoders as E, labels as L, quality as Q, registry as R, splits as Sp
from ..operators.order_stats import exact_quantiles
from ..sources import snapshots as Sn
from .base import Marts, _strip, query, r

# --- filters ------------------------------------------------------------------------


@query(
    "fl1_snapshot_equals",
    "select customer_id, age, cast(snapshot_date as varchar) as snapshot_date from fx_att where snapshot_date = date '1998-03-01'",
)
def fl1(t: Marts) -> DataFrame:
    return Sn.slice_month(t.fx_att, "1998-03-01").select("customer_id", "age", "snapshot_date")


@query(
    "fl2_month_on_book",
    "select loan_id, mob, dpd, cast(snapshot_date as varchar) as snapshot_date from c_lms where mob = 6",
)
def fl2(t: Marts) -> DataFrame:
    return L.at_month_on_book(t.ledger).select("loan_id", "mob", "dpd", "snapshot_date")


@query(
    "fl3_null_and_not_null",
    """select count(*) filter (where occupation = 'Unknown') as unknown_occupation,
 count(*) filter (where age is null) as age_null, count(*) filter (where age is not null) as age_present from c_att""",
)
def fl3(t: Marts) -> DataFrame:
    return t.att.agg(
        F.count_if(F.col("occupation") == "Unknown").alias("unknown_occupation"),
        F.count_if(F.col("age").isNull()).alias("age_null"),
        F.count_if(F.col("age").isNotNull()).alias("age_present"),
    )


@query(
    "fl4_oot_and_development",
    """select part, count(*) as n, count(distinct loan_id) as loans from (
 select loan_id, case when snapshot_date = date '2000-06-01' then 'oot' else 'development' end as part from g_lbl) group by part""",
)
def fl4(t: Marts) -> DataFrame:
    labels = t.gold_labels.withColumnRenamed("snapshot_date", "label_snapshot_date")
    parts = Sp.out_of_time_rows(labels, "2000-06-01").select("loan_id", F.lit("oot").alias("part")).unionByName(
        labels.where(~Sp.is_out_of_time("2000-06-01")).select("loan_id", F.lit("development").alias("part"))
    )
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("loan_id").alias("loans")
    )


@query(
    "fl5_regex_match",
    r"select customer_id, ssn, cast(snapshot_date as varchar) as snapshot_date from fx_att where regexp_matches(ssn, '^\d{3}-\d{2}-\d{4}$')",
)
def fl5(t: Marts) -> DataFrame:
    return t.fx_att.where(F.col("ssn").rlike(S.SSN_PATTERN)).select("customer_id", "ssn", "snapshot_date")


@query(
    "fl6_contains",
    "select customer_id, type_of_loan, cast(snapshot_date as varchar) as snapshot_date from fx_fin where contains(type_of_loan, 'Student Loan')",
)
def fl6(t: Marts) -> DataFrame:
    return t.fx_fin.where(F.col("type_of_loan").contains("Student Loan")).select(
        "customer_id", "type_of_loan", "snapshot_date"
    )


@query(
    "fl7_class_counts",
    """select source, count(*) as n, count(*) filter (where label = 1) as label_1, count(*) filter (where label = 0) as label_0,
 count(*) filter (where prediction = 1) as prediction_1, count(*) filter (where prediction = 0) as prediction_0
from fx_pairs group by source""",
)
def fl7(t: Marts) -> DataFrame:
    return t.fx_pairs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(F.col(c) == v).alias(f"{c}_{v}")
            for c in ("label", "prediction")
            for v in (1, 0)
        ],
    )


@query(
    "fl8_sentinel_and_key_lookup",
    """select 'sentinel' as kind, customer_id, cast(snapshot_date as varchar) as snapshot_date from fx_att where ssn = '#F%$D@*&8'
union all select 'key', customer_id, cast(snapshot_date as varchar) from fx_att where customer_id = 'CUS_77'""",
)
def fl8(t: Marts) -> DataFrame:
    columns = ["customer_id", "snapshot_date"]
    sentinel = t.fx_att.where(F.col("ssn") == "#F%$D@*&8").select(F.lit("sentinel").alias("kind"), *columns)
    key = t.fx_att.where(F.col("customer_id") == "CUS_77").select(F.lit("key").alias("kind"), *columns)
    return sentinel.unionByName(key)


_CALENDAR = " union all ".join(
    f"select '{name}' as \"table\", count(*) as rows, count(*) filter (where day({column}) <> 1) as violations from {table}"
    for name, table, column in (
        ("attributes", "fx_att", "snapshot_date"),
        ("financials", "fx_fin", "snapshot_date"),
        ("ledger", "fx_lms", "snapshot_date"),
        ("clickstream", "fx_cs", "snapshot_date"),
        ("orders", "orders", "cast(o_orderdate as date)"),
    )
)


@query("fl9_calendar_audit", _CALENDAR)
def fl9(t: Marts) -> DataFrame:
    raw_dates = t.orders.select(F.col("o_orderdate").cast("date").alias("snapshot_date"))
    return Q.calendar_audit(
        {
            "attributes": t.fx_att,
            "financials": t.fx_fin,
            "ledger": t.fx_lms,
            "clickstream": t.fx_cs,
            "orders": raw_dates,
        }
    )


@query(
    "fl10_register_of_type",
    """select cast(snapshot_date as varchar) as run_date, 'logistic' as model_type, count(*) as labels from g_lbl
 where label = 0 group by snapshot_date""",
)
def fl10(t: Marts) -> DataFrame:
    kind = F.when(F.col("label") == 0, "logistic").otherwise("boosted_trees")
    register = t.gold_labels.groupBy(F.col("snapshot_date").alias("run_date"), kind.alias("model_type")).agg(
        F.count(F.lit(1)).alias("labels")
    )
    return R.of_model_type(register, "logistic")


# --- projections --------------------------------------------------------------------


@query(
    "pr1_lower_columns",
    "select c_custkey as customer_key, c_name as customer_name, c_acctbal as account_balance from customer",
)
def pr1(t: Marts) -> DataFrame:
    raw = t.customer.select(
        F.col("c_custkey").alias("CUSTOMER_KEY"),
        F.col("c_name").alias("Customer_Name"),
        F.col("c_acctbal").alias("Account_BALANCE"),
    )
    return C.lower_columns(raw)


_CS_INT = ", ".join(f"cast(trunc(try_cast(fe_{i} as double)) as integer) as fe_{i}" for i in range(1, 21))


@query(
    "pr2_cast_by_map",
    f"select {_CS_INT}, customer_id, cast(snapshot_date as varchar) as snapshot_date from fx_cs",
)
def pr2(t: Marts) -> DataFrame:
    return C.clean_clickstream(t.fx_cs)


@query(
    "pr3_integer_via_float",
    f"""select customer_id, cast(snapshot_date as varchar) as snapshot_date, num_of_delayed_payment as raw,
 cast(trunc(try_cast({_strip('num_of_delayed_payment')} as double)) as integer) as num_of_delayed_payment_int from fx_fin""",
)
def pr3(t: Marts) -> DataFrame:
    raw = F.col("num_of_delayed_payment")
    return t.fx_fin.select(
        "customer_id",
        "snapshot_date",
        raw.alias("raw"),
        N.to_type(X.strip_to_null(raw), "int").alias("num_of_delayed_payment_int"),
    )


_LABELS_SQL = """select loan_id, customer_id, cast(loan_start_date as varchar) as loan_start_date, label, label_def,
 cast(snapshot_date as varchar) as snapshot_date from g_lbl"""


@query("pr4_explicit_projection", _LABELS_SQL)
def pr4(t: Marts) -> DataFrame:
    labels = t.ledger.where("mob = 6").withColumns(
        {"label": L.default_label(F.col("dpd")), "label_def": F.lit(L.label_definition())}
    )
    return labels.select(*S.LABEL_COLUMNS)


@query(
    "pr5_drop_columns",
    "select customer_id, age, occupation, cast(snapshot_date as varchar) as snapshot_date from c_att",
)
def pr5(t: Marts) -> DataFrame:
    return t.att.drop("name", "ssn")


@query(
    "pr6_copy_and_rename",
    """select customer_id, cast(snapshot_date as varchar) as loan_start_date, cast(snapshot_date as varchar) as feature_snapshot_date, annual_income
 from (select customer_id, snapshot_date, round(annual_income, 6) as annual_income from c_fin)""",
)
def pr6(t: Marts) -> DataFrame:
    from ..operators.joins import as_application_features

    return as_application_features(t.fin.select("customer_id", "snapshot_date", "annual_income"))


@query(
    "pr7_constant_label_definition",
    "select label_def, count(*) as n from g_lbl group by label_def",
)
def pr7(t: Marts) -> DataFrame:
    return t.gold_labels.groupBy("label_def").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pr8_features_beside_label",
    f"""with m as (select median(credit_history_age) as mid_age, median(total_emi_per_month) as mid_emi from g_merged)
 select loan_id, label, {r('coalesce(credit_history_age, mid_age)')} as credit_history_age_x, {r('coalesce(total_emi_per_month, mid_emi)')} as total_emi_x
 from g_merged, m""",
)
def pr8(t: Marts) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    from ..operators.models import assemble

    names = ["credit_history_age", "total_emi_per_month"]
    rows = t.stored(t.labelled.select("loan_id", "label", *names))
    filled = E.fill_nulls(rows, {c: q[0.5] for c, q in exact_quantiles(rows, {c: [0.5] for c in names}).items()})
    x = vector_to_array("features")
    return assemble(filled, names).select(
        "loan_id", "label", x[0].alias("credit_history_age_x"), x[1].alias("total_emi_x")
    )


# --- cleaning -----------------------------------------------------------------------


@query(
    "cl1_clean_underscores",
    f"""select customer_id, cast(snapshot_date as varchar) as snapshot_date, {_strip('name')} as name, {_strip('age')} as age,
 {_strip('occupation')} as occupation from fx_att""",
)
def cl1(t: Marts) -> DataFrame:
    cleaned = C.map_columns(t.fx_att, S.ATTRIBUTE_UNDERSCORE_COLUMNS, X.strip_to_null)
    return cleaned.select("customer_id", "snapshot_date", "name", "age", "occupation")


@query(
    "cl2_blank_to_null",
    """select customer_id, cast(snapshot_date as varchar) as snapshot_date, nullif(annual_income, '') as annual_income,
 nullif(type_of_loan, '') as type_of_loan from fx_fin""",
)
def cl2(t: Marts) -> DataFrame:
    cleaned = C.map_columns(t.fx_fin, ["annual_income", "type_of_loan"], X.blank_to_null)
    return cleaned.select("customer_id", "snapshot_date", "annual_income", "type_of_loan")


@query(
    "cl3_strip_quote_runs",
    """select customer_id, cast(snapshot_date as varchar) as snapshot_date, regexp_replace(name, '"{3,}', '', 'g') as name from fx_att""",
)
def cl3(t: Marts) -> DataFrame:
    return t.fx_att.select(
        "customer_id", "snapshot_date", X.remove_pattern(F.col("name"), S.QUOTE_RUN_PATTERN).alias("name")
    )


@query(
    "cl4_valid_pattern_or_null",
    r"""select customer_id, cast(snapshot_date as varchar) as snapshot_date,
 case when regexp_matches(ssn, '^\d{3}-\d{2}-\d{4}$') then ssn end as ssn from fx_att""",
)
def cl4(t: Marts) -> DataFrame:
    return t.fx_att.select(
        "customer_id", "snapshot_date", X.keep_matching(F.col("ssn"), S.SSN_PATTERN).alias("ssn")
    )


@query(
    "cl5_range_or_null",
    f"""select customer_id, cast(snapshot_date as varchar) as snapshot_date, case when a between 1 and 150 then a end as age
 from (select *, cast(trunc(try_cast({_strip('age')} as double)) as integer) as a from fx_att)""",
)
def cl5(t: Marts) -> DataFrame:
    age = N.null_outside(N.to_type(X.strip_to_null(F.col("age")), "int"), *S.AGE_RANGE)
    return t.fx_att.select("customer_id", "snapshot_date", age.alias("age"))


_NONNEG = ", ".join(
    f"case when trunc(try_cast({_strip(c)} as double)) >= 0 then cast(trunc(try_cast({_strip(c)} as double)) as integer) end as {c}"
    for c in S.FINANCIAL_NONNEGATIVE_COLUMNS
)


@query(
    "cl6_negative_to_null",
    f"select customer_id, cast(snapshot_date as varchar) as snapshot_date, {_NONNEG} from fx_fin",
)
def cl6(t: Marts) -> DataFrame:
    def fix(c):
        return N.null_if_negative(N.to_type(X.strip_to_null(c), "int"))

    return C.map_columns(t.fx_fin, S.FINANCIAL_NONNEGATIVE_COLUMNS, fix).select(
        "customer_id", "snapshot_date", *S.FINANCIAL_NONNEGATIVE_COLUMNS
    )


@query(
    "cl7_short_to_null",
    """select customer_id, cast(snapshot_date as varchar) as snapshot_date,
 case when length(payment_behaviour) >= 10 then payment_behaviour end as payment_behaviour from fx_fin""",
)
def cl7(t: Marts) -> DataFrame:
    kept = X.null_if_shorter(F.col("payment_behaviour"), S.PAYMENT_BEHAVIOUR_MIN_LENGTH)
    return t.fx_fin.select("customer_id", "snapshot_date", kept.alias("payment_behaviour"))


@query(
    "cl8_fill_unknown",
    """select credit_mix, payment_behaviour, type_of_loan, count(*) as n from c_fin
 group by credit_mix, payment_behaviour, type_of_loan""",
)
def cl8(t: Marts) -> DataFrame:
    return t.fin.groupBy(*S.FINANCIAL_UNKNOWN_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cl9_sentinel_to_null",
    """select nullif(payment_of_min_amount, 'NM') as payment_of_min_amount, nullif(credit_mix, 'Unknown') as credit_mix, count(*) as n
 from c_fin group by 1, 2""",
)
def cl9(t: Marts) -> DataFrame:
    from ..operators.encoders import null_sentinels

    return (
        null_sentinels(t.fin, S.ENCODING_SENTINELS)
        .groupBy(*S.ENCODING_SENTINELS)
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "cl10_nan_to_null",
    f"""select l_orderkey, l_linenumber, case when l_quantity < 3 then null else {r('l_extendedprice')} end as price,
 case when l_returnflag = 'R' then null else {r('l_tax')} end as tax from lineitem""",
)
def cl10(t: Marts) -> DataFrame:
    nan = F.lit(float("nan"))
    dirty = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_quantity") < 3, nan).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_returnflag") == "R", nan).otherwise(F.col("l_tax")).alias("tax"),
    )
    return C.restore_nulls(dirty, ["price", "tax"])


@query(
    "cl11_numeric_zero_fill",
    f"""select loan_id, customer_id, tenure, installment_num, {r('paid_amt')} as paid_amt, {r('balance')} as balance,
 cast(first_missed_date as varchar) as first_missed_date, cast(snapshot_date as varchar) as snapshot_date from c_lms""",
)
def cl11(t: Marts) -> DataFrame:
    return t.ledger.select(
        "loan_id",
        "customer_id",
        "tenure",
        "installment_num",
        "paid_amt",
        "balance",
        "first_missed_date",
        "snapshot_date",
    )


_DOUBLED = "(select * from fx_fin union all select * from fx_fin)"


@query(
    "cl12_full_row_dedup",
    f"""select customer_id, cast(snapshot_date as varchar) as snapshot_date, annual_income, credit_mix, payment_behaviour
 from (select distinct * from {_DOUBLED})""",
)
def cl12(t: Marts) -> DataFrame:
    doubled = t.fx_fin.unionByName(t.fx_fin)
    return C.dedup(doubled).select(
        "customer_id", "snapshot_date", "annual_income", "credit_mix", "payment_behaviour"
    )


@query(
    "cl13_drop_null_rows",
    f"""select customer_id, cast(snapshot_date as varchar) as snapshot_date, {r('changed_credit_limit')} as changed_credit_limit
 from c_fin where changed_credit_limit is not null""",
)
def cl13(t: Marts) -> DataFrame:
    return C.drop_null_rows(t.fin.select("customer_id", "snapshot_date", "changed_credit_limit"))


# --- whole cleaned tables -------------------------------------------------------------


@query(
    "clean_attributes",
    "select customer_id, name, age, ssn, occupation, cast(snapshot_date as varchar) as snapshot_date from c_att",
)
def clean_attributes(t: Marts) -> DataFrame:
    return t.att


_FIN_OUT = ", ".join(
    f"{r(c)} as {c}" if k == "double" else (f"cast({c} as varchar) as {c}" if k == "date" else c)
    for c, k in S.FINANCIALS.items()
)


@query("clean_financials", f"select {_FIN_OUT} from c_fin")
def clean_financials(t: Marts) -> DataFrame:
    return t.fin


@query("label_30dpd_6mob", _LABELS_SQL)
def label_30dpd_6mob(t: Marts) -> DataFrame:
    return t.gold_labels
