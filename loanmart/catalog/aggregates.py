"""Aggregations and audits (AG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..operators import drift as D, features as Fe, metrics as Me, quality as Q
from ..operators.order_stats import exact_quantiles
from ..operators.encoders import fit_scalers
from .base import Marts, query, r

_PRICE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def params(t: Marts, rows: list[tuple], schema: str) -> DataFrame:
    """Fitted parameters (a few numbers per column) as a table."""
    return t.spark.createDataFrame(rows, schema)


@query("ag1_row_counts", """select 'attributes' as "table", count(*) as rows, count(*) - (select count(*) from (select distinct * from fx_att)) as duplicates from fx_att
 union all select 'financials', count(*), count(*) - (select count(*) from (select distinct * from fx_fin)) from fx_fin
 union all select 'ledger', count(*), count(*) - (select count(*) from (select distinct * from fx_lms)) from fx_lms""")
def ag1(t: Marts) -> DataFrame:
    tables = {"attributes": t.fx_att, "financials": t.fx_fin, "ledger": t.fx_lms}
    parts = [
        Q.duplicate_audit(df).select(F.lit(name).alias("table"), "rows", "duplicates")
        for name, df in tables.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NULLS = " union all ".join(
    f"select '{c}' as \"column\", count(*) filter (where {c} is null) as nulls, count(*) as rows from c_fin"
    for c in S.FINANCIALS
)


@query("ag2_null_audit", _NULLS)
def ag2(t: Marts) -> DataFrame:
    return Q.null_audit(t.fin)


_P97 = " union all ".join(
    f"select '{c}' as \"column\", {r(f'quantile_cont({c}, 0.97)')} as cap from lineitem" for c in _PRICE
) + "".join(
    f" union all select '{c}', {r(f'quantile_cont(cast({c} as double), 0.97)')} from c_fin"
    for c in ("annual_income", "outstanding_debt", "num_of_delayed_payment")
)


@query("ag3_percentile_97", _P97)
def ag3(t: Marts) -> DataFrame:
    found = exact_quantiles(t.lineitem, {c: [0.97] for c in _PRICE})
    fin = t.stored(t.fin.select("annual_income", "outstanding_debt", "num_of_delayed_payment"))
    found |= exact_quantiles(fin, {c: [0.97] for c in fin.columns})
    return params(t, [(c, v[0.97]) for c, v in found.items()], "column string, cap double")


_MEDIANS = " union all ".join(
    f"select '{c}' as \"column\", {r(f'median({c})')} as median from lineitem" for c in _PRICE
) + "".join(
    f" union all select '{c}', {r(f'median(cast({c} as double))')} from c_fin"
    for c in ("monthly_balance", "changed_credit_limit", "num_credit_card")
)


@query("ag4_median", _MEDIANS)
def ag4(t: Marts) -> DataFrame:
    found = exact_quantiles(t.lineitem, {c: [0.5] for c in _PRICE})
    fin = t.stored(t.fin.select("monthly_balance", "changed_credit_limit", "num_credit_card"))
    found |= exact_quantiles(fin, {c: [0.5] for c in fin.columns})
    return params(t, [(c, v[0.5]) for c, v in found.items()], "column string, median double")


@query("ag5_count_per_key", "select customer_id, count(*) as n from fx_lms group by customer_id")
def ag5(t: Marts) -> DataFrame:
    return Q.value_counts(t.fx_lms, "customer_id")


@query(
    "ag6_distinct_per_key",
    "select customer_id, count(distinct loan_id) as loans from fx_lms group by customer_id",
)
def ag6(t: Marts) -> DataFrame:
    return Q.distinct_per_key(t.fx_lms, "customer_id", "loan_id", "loans").orderBy(F.col("loans").desc())


_SUMMARY = " union all ".join(
    f"""select '{c}' as "column", count({c}) as n, {r(f'avg({c})')} as mean, round(stddev_samp({c}), 4) as stddev, {r(f'min({c})')} as min,
 {r(f'quantile_cont({c}, 0.25)')} as q25, {r(f'quantile_cont({c}, 0.5)')} as q50, {r(f'quantile_cont({c}, 0.75)')} as q75, {r(f'max({c})')} as max from lineitem"""
    for c in _PRICE
)


@query("ag7_summary_profile", _SUMMARY)
def ag7(t: Marts) -> DataFrame:
    return Q.profile(t.lineitem, _PRICE).withColumn("stddev", F.round("stddev", 4))


_TEXTS = {"fx_att": tuple(S.ATTRIBUTES), "fx_fin": tuple(S.FINANCIALS)}
_TEXT_SUMMARY = " union all ".join(
    f"""select '{name[3:]}' as "table", '{c}' as "column", count({c}) as n, min(cast({c} as varchar)) as min, max(cast({c} as varchar)) as max from {name}"""
    for name, columns in _TEXTS.items()
    for c in columns
)


@query("ag7_text_profile", _TEXT_SUMMARY)
def ag7_text(t: Marts) -> DataFrame:
    parts = [Q.text_profile(getattr(t, name), columns).withColumn("table", F.lit(name[3:])) for name, columns in _TEXTS.items()]
    return parts[0].unionByName(parts[1])


_SCALE = " union all ".join(
    f"select '{c}' as \"column\", {r(f'avg({c})')} as mean, round(stddev_pop({c}), 4) as std from lineitem" for c in _PRICE
)


@query("ag8_mean_and_population_std", _SCALE)
def ag8(t: Marts) -> DataFrame:
    fitted = fit_scalers(t.lineitem, _PRICE)
    return params(
        t, [(c, m, round(s, 4)) for c, (m, s) in fitted.items()], "column string, mean double, std double"
    )


@query(
    "ag9_class_balance",
    f"""select count(*) filter (where label = 0) as n_0, count(*) filter (where label = 1) as n_1,
 {r('count(*) filter (where label = 0) / cast(count(*) filter (where label = 1) as double)')} as scale_pos_weight from g_lbl""",
)
def ag9(t: Marts) -> DataFrame:
    return Me.class_balance(t.gold_labels)


@query(
    "ag10_window_statistics",
    f"""select {r('avg(share)')} as avg_share, {r('max(share)')} as max_share, {r('min(share)')} as min_share from
 (select count(*) filter (where label = 1) / cast(count(*) as double) as share from g_lbl group by snapshot_date order by snapshot_date desc limit 30)""",
)
def ag10(t: Marts) -> DataFrame:
    records = t.gold_labels.groupBy(F.col("snapshot_date").alias("date")).agg(
        (F.count_if(F.col("label") == 1) / F.count(F.lit(1))).alias("share")
    )
    return D.last_records(records, 30).agg(
        F.avg("share").alias("avg_share"), F.max("share").alias("max_share"), F.min("share").alias("min_share")
    )


@query(
    "ag11_count_by_status",
    """select case when dpd is null then 'unknown' when dpd = 0 then 'current' when dpd < 30 then 'late' else 'default' end as status,
 count(*) as n from c_lms group by 1""",
)
def ag11(t: Marts) -> DataFrame:
    dpd = F.col("dpd")
    status = (
        F.when(dpd.isNull(), "unknown").when(dpd == 0, "current").when(dpd < 30, "late").otherwise("default")
    )
    return Q.value_counts(t.ledger.select(status.alias("status")), "status")


@query(
    "ag12_pearson",
    """select l_returnflag, round(case when isnan(c) then null else c end, 4) as price_quantity,
 cast(null as double) as price_constant from
 (select l_returnflag, corr(l_extendedprice, l_quantity) as c from lineitem group by l_returnflag)""",
)
def ag12(t: Marts) -> DataFrame:
    rows = t.lineitem.withColumn("one", F.lit(1.0))
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag").agg(
        F.round(D.pearson(price, F.col("l_quantity")), 4).alias("price_quantity"),
        D.pearson(price, F.col("one")).alias("price_constant"),
    )


@query(
    "ag13_loan_vocabulary",
    r"""select distinct loan_type from (select trim(unnest(regexp_split_to_array(type_of_loan, ',\s*and\s|,\s|\sand\s'))) as loan_type from c_fin)
 where loan_type not in ('', 'Unknown', 'Not Specified')""",
)
def ag13(t: Marts) -> DataFrame:
    return Fe.loan_vocabulary(t.fin)
