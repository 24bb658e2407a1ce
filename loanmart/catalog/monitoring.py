"""Result rates, concept drift and feature drift (MO), on whole tables by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as Dt
from ..operators import drift as D, metrics as Me, registry as R
from ..plans.drift_counts import DriftCounts
from .base import Marts, query, r

# the fixture months lie 27 years before the deployments of the product
FIXTURE_DEPLOYMENTS = (
    R.Deployment("1996-09-01", "lr_clf"),
    R.Deployment("1996-12-01", "xgb_clf"),
    R.Deployment("1997-02-01", "xgb_clf", recall_threshold=0.5, f1_threshold=0.4, gini_threshold=0.0),
    R.Deployment("1997-08-01", "xgb_clf", recall_threshold=0.45, f1_threshold=0.35, gini_threshold=0.05),
)
ACTIVE_SQL = "active as (select * from (values {}) v(model_date, model, version, recall_threshold, f1_threshold, gini_threshold))".format(
    ", ".join(
        f"(date '{d.effective_date}', '{d.model}', '{d.version}', {d.recall_threshold}::double, {d.f1_threshold}::double, {d.gini_threshold}::double)"
        for d in FIXTURE_DEPLOYMENTS
    )
)

# planted predictions: one per financials row
_PREDICTED = "case when total_emi_per_month > 250 then 1 else 0 end"
PREDICTIONS_SQL = f"select customer_id, snapshot_date as loan_start_date, {_PREDICTED} as prediction from c_fin"
PAIRS_SQL = f"""pairs as (select l.snapshot_date as run_date, l.loan_id, l.label, p.prediction from g_lbl l
 join ({PREDICTIONS_SQL}) p on l.customer_id = p.customer_id and l.loan_start_date = p.loan_start_date)"""


def planted_predictions(t: Marts) -> DataFrame:
    return t.fin.select(
        "customer_id",
        F.col("snapshot_date").alias("loan_start_date"),
        F.when(F.col("total_emi_per_month") > 250, 1).otherwise(0).alias("prediction"),
    )


def paired(t: Marts) -> DataFrame:
    from ..operators.joins import labels_with_predictions

    pairs = labels_with_predictions(t.gold_labels, planted_predictions(t))
    return pairs.select(F.col("snapshot_date").alias("run_date"), "loan_id", "label", "prediction")


def metrics_sql(source: str, by: str) -> str:
    """recall, f1, auc and gini of (label, prediction) rows per group, as a subquery text."""
    return f"""(select {by}, tp, fp, fn, tn,
 coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as recall,
 coalesce(2 * tp / nullif(cast(2 * tp + fp + fn as double), 0), 0) as f1,
 (tp / nullif(cast(tp + fn as double), 0) + tn / nullif(cast(tn + fp as double), 0)) / 2 as auc,
 (tp + tn) / nullif(cast(tp + tn + fp + fn as double), 0) as accuracy
 from (select {by}, count(*) filter (where label = 1 and prediction = 1) as tp, count(*) filter (where label = 0 and prediction = 1) as fp,
  count(*) filter (where label = 1 and prediction = 0) as fn, count(*) filter (where label = 0 and prediction = 0) as tn
  from {source} group by {by}))"""


# --- result rates ---------------------------------------------------------------------------

_RATES = f"""rates as (select run_date, label_count, label_1, label_0, result_count, result_1, result_0,
 label_1 / nullif(cast(label_count as double), 0) as labels_percent, result_1 / nullif(cast(result_count as double), 0) as results_percent
 from (select run_date, count(*) filter (where k = 'l') as label_count, count(*) filter (where k = 'l' and y = 1) as label_1,
  count(*) filter (where k = 'l' and y = 0) as label_0, count(*) filter (where k = 'r') as result_count,
  count(*) filter (where k = 'r' and y = 1) as result_1, count(*) filter (where k = 'r' and y = 0) as result_0
  from (select snapshot_date as run_date, label as y, 'l' as k from g_lbl
   union all select loan_start_date, prediction, 'r' from ({PREDICTIONS_SQL})) group by run_date))"""
_COUNTS = "label_count, label_1, label_0, result_count, result_1, result_0"
_RUN = "cast(run_date as varchar) as run_date"


def rates(t: Marts) -> DataFrame:
    return Me.result_rates(
        t.gold_labels.withColumnRenamed("snapshot_date", "run_date"),
        planted_predictions(t).withColumnRenamed("loan_start_date", "run_date"),
    )


@query("mo1_positive_rates", f"with {_RATES} select {_RUN}, {_COUNTS} from rates")
def mo1(t: Marts) -> DataFrame:
    return rates(t).drop("labels_percent", "results_percent")


_GAP = "abs(labels_percent - results_percent) * 100"


@query(
    "mo2_sudden_change_alert",
    f"with {_RATES} select {_RUN}, {r(_GAP)} as gap_percent, case when {_GAP} > 20 then 1 else 0 end as alert from rates",
)
def mo2(t: Marts) -> DataFrame:
    return Me.rate_alerts(rates(t), 20.0).select("run_date", "gap_percent", "alert")


@query(
    "mo3_rate_history",
    f"with {_RATES} select {_RUN}, {_COUNTS}, {r('labels_percent')} as labels_percent, {r('results_percent')} as results_percent from rates",
)
def mo3(t: Marts) -> DataFrame:
    return rates(t)


# --- concept drift ------------------------------------------------------------------------------


@query(
    "mo4_binary_metrics",
    f"""select source, tp, fp, fn, tn, {r('recall')} as recall, {r('f1')} as f1, {r('auc')} as auc, {r('2 * auc - 1')} as gini, {r('accuracy')} as accuracy
 from {metrics_sql('fx_pairs', 'source')}""",
)
def mo4(t: Marts) -> DataFrame:
    return Me.binary_metrics(t.fx_pairs, by=("source",))


_SCORED = f"scored as (select *, 2 * auc - 1 as gini from {metrics_sql('pairs', 'run_date')})"
_ASOF = "scored s left join active a on a.model_date = (select max(model_date) from active where model_date <= s.run_date)"


@query(
    "mo5_threshold_checks",
    f"""with {ACTIVE_SQL}, {PAIRS_SQL}, {_SCORED} select {_RUN}, {r('recall')} as recall, {r('f1')} as f1, {r('gini')} as gini,
 cast(coalesce(recall < recall_threshold, false) as integer) as recall_below, cast(coalesce(f1 < f1_threshold, false) as integer) as f1_below,
 cast(coalesce(gini < gini_threshold, false) as integer) as gini_below from {_ASOF}""",
)
def mo5(t: Marts) -> DataFrame:
    scored = R.with_active_deployment(Me.binary_metrics(paired(t), by=("run_date",)), "run_date", FIXTURE_DEPLOYMENTS)
    return Me.threshold_checks(scored).select(
        "run_date", "recall", "f1", "gini", "recall_below", "f1_below", "gini_below"
    )


@query(
    "mo6_drift_record",
    f"""with {ACTIVE_SQL}, {PAIRS_SQL}, {_SCORED} select {_RUN}, model as active_model, cast(model_date as varchar) as active_model_date,
 version as active_model_version, 'recall' as active_metric_p0, recall_threshold as active_threshold_p0, 'f1' as active_metric_p1,
 f1_threshold as active_threshold_p1, 'gini' as active_metric_p2, gini_threshold as active_threshold_p2,
 {r('recall')} as recall_score, {r('f1')} as f1_score, {r('auc')} as auc_score, {r('gini')} as gini_score from {_ASOF}""",
)
def mo6(t: Marts) -> DataFrame:
    return R.drift_records(Me.binary_metrics(paired(t), by=("run_date",)), FIXTURE_DEPLOYMENTS)


# --- feature drift --------------------------------------------------------------------------------
# reference population: lines shipped before 1998; monitored: every month from then on
_FEATURES = ("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber")
_SPLIT_DATE = "1998-01-01"
_PROBS = "[" + ", ".join(f"{i / 10}::double" for i in range(11)) + "]"


def psi_sql(long: str) -> str:
    """CTE chain reference -> edges -> shares -> psi(date, feature, psi) of a long table (date, feature, x, ref)."""
    return f"""long as ({long}),
edges as (select feature, quantile_cont(x, {_PROBS}) as e from long where ref group by feature),
binned as (select ref, date, l.feature, case when x > e[11] then -1 else len(list_filter(e[1:10], lambda v: v <= x)) - 1 end as b
 from long l join edges using (feature)),
bins as (select unnest(range(0, 10)) as b),
tot as (select ref, date, feature, count(*) as n from binned group by all),
cnt as (select ref, date, feature, b, count(*) as c from binned group by all),
shares as (select t.ref, t.date, t.feature, bins.b, case when coalesce(c, 0) = 0 then 0.0001e0 else c / cast(n as double) end as s
 from tot t cross join bins left join cnt on cnt.ref = t.ref and cnt.date is not distinct from t.date and cnt.feature = t.feature and cnt.b = bins.b),
psi as (select a.date, a.feature, sum((a.s - e.s) * ln(a.s / e.s)) as psi from shares a join shares e on a.feature = e.feature and a.b = e.b
 where not a.ref and e.ref group by a.date, a.feature),
overall as (select date, avg(psi) as overall_psi from psi group by date)"""


def _long(features, current: str) -> str:
    return " union all ".join(
        f"""select cast(case when l_shipdate >= date '{_SPLIT_DATE}' then {current} end as date) as date, '{f}' as feature, cast({f} as double) as x,
 l_shipdate < date '{_SPLIT_DATE}' as ref from lineitem"""
        for f in features
    )


_MONTHLY = psi_sql(_long(_FEATURES, "date_trunc('month', l_shipdate)"))
_STATUS = "case when {0} < 0.1 then 'No significant drift' when {0} < 0.2 then 'Moderate drift' else 'Significant drift' end"


def _parts(t: Marts) -> tuple[DataFrame, DataFrame]:
    rows = t.lineitem.select("l_shipdate", *_FEATURES)
    date = Dt.month_of(F.col("l_shipdate")).alias("date")
    return (
        rows.where(F.col("l_shipdate") < F.lit(_SPLIT_DATE).cast("date")),
        rows.where(F.col("l_shipdate") >= F.lit(_SPLIT_DATE).cast("date")).select(date, *_FEATURES),
    )


def monthly_psi(t: Marts) -> DataFrame:
    """Written once: what is made of it reads its few rows several times."""
    reference, current = _parts(t)
    return t.stored(D.feature_psi(current, D.fit_reference(reference, _FEATURES), by=("date",)), "psi")


def _stored_counts(t: Marts) -> tuple[DataFrame, D.Reference]:
    """Records of all months, written as the monthly job writes them and read back."""
    rows, current = _parts(t)
    store, reference = DriftCounts(t.scratch(), _SPLIT_DATE), D.fit_reference(rows, _FEATURES)
    store.add(current.withColumn("stamp", F.lit("lineitem")), reference)
    return store.stored(t.spark).drop("stamp", "model_date"), reference


def dense_psi(t: Marts) -> DataFrame:
    return D.dense_feature_psi(monthly_psi(t), _FEATURES)


@query(
    "mo7_psi",
    f"with {psi_sql(_long(_FEATURES, 'date ' + repr(_SPLIT_DATE)))} select feature, {r('psi')} as psi from psi",
)
def mo7(t: Marts) -> DataFrame:
    reference, current = _parts(t)
    return D.feature_psi(current, D.fit_reference(reference, _FEATURES))


@query(
    "mo8_monthly_psi",
    f"""with {_MONTHLY} select cast(p.date as varchar) as date, feature, {r('psi')} as psi, {r('overall_psi')} as overall_psi
 from psi p join overall o on p.date = o.date""",
)
def mo8(t: Marts) -> DataFrame:
    return dense_psi(t)


@query(
    "mo8_psi_from_stored_counts",
    f"""with {_MONTHLY} select cast(p.date as varchar) as date, feature, {r('psi')} as psi, {r('overall_psi')} as overall_psi
 from psi p join overall o on p.date = o.date""",
)
def mo8_stored(t: Marts) -> DataFrame:
    """The same from the records kept for each month."""
    counted, reference = _stored_counts(t)
    return D.dense_feature_psi(D.psi_of_counts(counted, reference, by=("date",)), _FEATURES)


_QUARTERLY = psi_sql(_long(_FEATURES, "date_trunc('quarter', l_shipdate)"))


@query(
    "mo8_quarterly_psi",
    f"with {_QUARTERLY} select cast(date as varchar) as date, feature, {r('psi')} as psi from psi",
)
def mo8_quarterly(t: Marts) -> DataFrame:
    """PSI of quarters from the records of their months; no row is read again."""
    counted, reference = _stored_counts(t)
    quarters = counted.withColumn("date", F.trunc("date", "quarter"))
    return D.psi_of_counts(D.merged_counts(quarters, ("date",)), reference, by=("date",))


@query(
    "mo9_drift_status",
    f"with {_MONTHLY} select cast(date as varchar) as date, {r('overall_psi')} as overall_psi, {_STATUS.format('overall_psi')} as drift_status from overall",
)
def mo9(t: Marts) -> DataFrame:
    return D.overall_psi(monthly_psi(t))


_REFERENCE_ROWS = f"""with {ACTIVE_SQL} select cast(d.run_date as varchar) as run_date, a.model, cast(a.model_date as varchar) as model_date,
 count(g.loan_id) as reference_rows from (select distinct snapshot_date as run_date from g_lbl) d
 left join active a on a.model_date = (select max(model_date) from active where model_date <= d.run_date)
 left join g_lbl g on g.snapshot_date <= a.model_date group by 1, 2, 3"""


@query("mo10_reference_population", _REFERENCE_ROWS)
def mo10(t: Marts) -> DataFrame:
    """Size of the rows the model active in each month was trained on."""
    months = t.gold_labels.groupBy(F.col("snapshot_date").alias("run_date")).agg(F.count(F.lit(1)).alias("n"))
    dated = R.with_active_deployment(months, "run_date", FIXTURE_DEPLOYMENTS)
    # rows known at each deployment, from the monthly counts: one counter per deployment
    known = months.agg(
        *[
            F.sum(F.when(F.col("run_date") <= F.lit(d.effective_date).cast("date"), F.col("n"))).alias(f"d{i}")
            for i, d in enumerate(FIXTURE_DEPLOYMENTS)
        ]
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(d.effective_date).cast("date").alias("model_date"), F.col(f"d{i}").alias("reference_rows")
                    )
                    for i, d in enumerate(FIXTURE_DEPLOYMENTS)
                ]
            )
        ).alias("k")
    )
    return (
        dated.join(known.select("k.*"), "model_date", "left")
        .fillna(0, ["reference_rows"])
        .select("run_date", "model", "model_date", "reference_rows")
    )


@query(
    "mo11_average_feature_psi",
    f"with {_MONTHLY} select feature, {r('avg(psi)')} as avg_psi from psi where date in (select date from overall order by date desc limit 30) group by feature",
)
def mo11(t: Marts) -> DataFrame:
    return D.average_feature_psi(D.dense_feature_psi(D.recent(monthly_psi(t), 30), _FEATURES))


@query(
    "mo12_status_distribution",
    f"""with {_MONTHLY} select drift_status, count(*) as records, {r('count(*) / cast((select count(*) from overall) as double)')} as share
 from (select {_STATUS.format('overall_psi')} as drift_status from overall) group by drift_status""",
)
def mo12(t: Marts) -> DataFrame:
    return D.status_distribution(D.overall_psi(monthly_psi(t)))


@query(
    "mo13_correlated_features",
    f"""with {_MONTHLY} select feature, {r('correlation')} as correlation from
 (select feature, corr(psi, overall_psi) as correlation from psi p join overall o on p.date = o.date group by feature)
 order by abs(correlation) desc, feature limit 5""",
)
def mo13(t: Marts) -> DataFrame:
    return D.drift_correlation(dense_psi(t), 5)


@query(
    "mo14_report_summary",
    f"""with {_MONTHLY} select (select count(*) from lineitem where l_shipdate < date '{_SPLIT_DATE}') as reference_rows, count(*) as records, {r('avg(overall_psi)')} as avg_psi, {r('max(overall_psi)')} as max_psi, {r('min(overall_psi)')} as min_psi,
 case when max(overall_psi) > 0.2 then 'Significant drift detected - consider model retraining' when max(overall_psi) > 0.1
 then 'Moderate drift - monitor closely' else 'Model is stable - continue monitoring' end as recommendation from overall""",
)
def mo14(t: Marts) -> DataFrame:
    reference, current = _parts(t)
    psi = D.feature_psi(current, D.fit_reference(reference, _FEATURES), by=("date",))
    return D.report_summary(D.overall_psi(psi), reference.count())


@query(
    "mo14_high_drift_features",
    f"with {_MONTHLY} select feature, {r('max(psi)')} as max_psi from psi group by feature having max(psi) > 0.2",
)
def mo14_high(t: Marts) -> DataFrame:
    return D.high_drift_features(monthly_psi(t))
