"""Result rates, concept drift and feature drift of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import drift as D, joins as J, metrics as Me, registry as R
from ..operators.splits import train_and_valid
from ..sources.sinks import export_records, write_csv, write_parquet, write_records
from ..sources.snapshots import exists
from .data_month import gold
from .drift_counts import DriftCounts
from .mart import Mart
from .training_month import load_encoders


def monitor_rates(
    spark: SparkSession, mart: Mart, run_date: str, threshold_percent: float = Me.RATE_ALERT_PERCENT
) -> DataFrame:
    """Positive rates of known labels and of this run's predictions, with the alert flag."""
    _, labels = gold(spark, mart, run_date)
    predictions = spark.read.parquet(f"{mart.outbox}/parquet/run_date={run_date}")
    on = F.lit(run_date).cast("date")
    rates = Me.rate_alerts(
        Me.result_rates(labels.withColumn("run_date", on), predictions.withColumn("run_date", on)),
        threshold_percent,
    )
    write_records(rates, mart.monitoring("result_rates"))
    export_records(spark, mart.monitoring("result_rates"), mart.export("result_rates"))
    return spark.read.parquet(mart.monitoring("result_rates"))


def previous_run(run_date: str) -> str:
    year, month, day = (int(p) for p in run_date.split("-"))
    return f"{year - (month == 1)}-{(month - 2) % 12 + 1:02d}-{day:02d}"


def monitor_concept_drift(
    spark: SparkSession, mart: Mart, run_date: str, deployments=R.DEPLOYMENTS
) -> DataFrame:
    """Metrics of last month's predictions against the labels known now, with a flag per metric below its threshold.

    Nothing is recorded before the first scored month.
    """
    earlier = f"{mart.outbox}/parquet/run_date={previous_run(run_date)}"
    if not exists(spark, earlier):
        nothing = spark.createDataFrame([], "prediction int, label int")
        return _drift_records(nothing, run_date, deployments).limit(0)
    _, labels = gold(spark, mart, run_date)
    paired = J.labels_with_predictions(labels, spark.read.parquet(earlier))
    stored = f"{mart.monitoring('pairs')}/run_date={run_date}"
    write_parquet(paired, stored)
    paired = spark.read.parquet(stored)
    write_csv(paired, f"{mart.monitoring('pairs_csv')}/run_date={run_date}")
    write_records(_drift_records(paired, run_date, deployments), mart.monitoring("concept_drift"))
    export_records(spark, mart.monitoring("concept_drift"), mart.export("concept_drift"))
    return spark.read.parquet(mart.monitoring("concept_drift"))


def _drift_records(paired: DataFrame, run_date: str, deployments) -> DataFrame:
    metrics = Me.binary_metrics(paired).withColumn("run_date", F.lit(run_date).cast("date"))
    flags = Me.threshold_checks(R.with_active_deployment(metrics, "run_date", deployments))
    below = [c for c in flags.columns if c.endswith("_below")]
    return R.drift_records(metrics, deployments).join(flags.select("run_date", *below), "run_date")


def monitor_feature_drift(
    spark: SparkSession, mart: Mart, run_date: str, run_dates, deployments=R.DEPLOYMENTS
) -> dict[str, DataFrame]:
    """PSI of each scored month against the training rows of the active model, and the report tables.

    Only months without valid counts are read; everything else comes from the stored counts and the stored
    reference.  Before the first deployment all tables are empty.
    """
    active = R.model_on(run_date, deployments)
    if active is None:
        return _report(spark.createDataFrame([], "date date, feature string, psi double"), ["none"], 0)
    view = mart.encoded("view", active.effective_date)
    reference_view = spark.read.parquet(view)
    features = load_encoders(spark, mart, active.effective_date).feature_columns(reference_view)
    store = DriftCounts(mart.monitoring("drift"), active.effective_date)
    reference = store.reference(spark, view, train_and_valid(reference_view), features)
    months = {d: mart.encoded("inference", d) for d in run_dates}
    store.update(spark, months, reference)
    psi = D.psi_of_counts(store.counts(spark, months, reference), reference.reference, by=("date",))
    write_parquet(psi, mart.monitoring(f"psi/run_date={run_date}"))
    psi = spark.read.parquet(mart.monitoring(f"psi/run_date={run_date}"))
    return _report(psi, list(reference.reference.edges), reference.rows)


def _report(psi: DataFrame, features: list[str], reference_rows: int) -> dict[str, DataFrame]:
    overall = D.overall_psi(psi)
    dense = D.dense_feature_psi(psi, features)
    return {
        "psi": psi,
        "overall": overall,
        "average_by_feature": D.average_feature_psi(dense),
        "status_distribution": D.status_distribution(overall),
        "correlated_features": D.drift_correlation(dense),
        "summary": D.report_summary(overall, reference_rows),
        "high_drift": D.high_drift_features(psi),
    }
