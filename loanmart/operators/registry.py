"""Model register and the deployment history."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Deployment:
    effective_date: str
    model: str
    version: str = "30dpd_6mob"
    recall_threshold: float = 0.70
    f1_threshold: float = 0.60
    gini_threshold: float = 0.30


# fixed values: model active from each date on
DEPLOYMENTS = (
    Deployment("2023-09-01", "lr_clf"),
    Deployment("2023-12-01", "xgb_clf"),
    Deployment("2024-02-01", "xgb_clf"),
    Deployment("2024-08-01", "xgb_clf"),
)


def active_deployment(as_of: Column, deployments=DEPLOYMENTS) -> Column:
    """Struct of the latest deployment not after ``as_of``; NULL before the first.

    The history is configuration of a few rows, so it travels as a literal array
    and the as-of lookup is an expression, not a join.
    """
    history = F.array(
        *[
            F.struct(
                F.lit(d.effective_date).cast("date").alias("model_date"),
                F.lit(d.model).alias("model"),
                F.lit(d.version).alias("version"),
                F.lit(d.recall_threshold).alias("recall_threshold"),
                F.lit(d.f1_threshold).alias("f1_threshold"),
                F.lit(d.gini_threshold).alias("gini_threshold"),
            )
            for d in deployments
        ]
    )
    return F.array_max(F.filter(history, lambda d: d["model_date"] <= as_of))


def with_active_deployment(df: DataFrame, as_of: str, deployments=DEPLOYMENTS) -> DataFrame:
    """Add the active model's columns for the date column ``as_of``."""
    found = df.withColumn("_active", active_deployment(F.col(as_of), deployments))
    return found.select(*df.columns, "_active.*")


def model_on(as_of: str, deployments=DEPLOYMENTS) -> Deployment | None:
    """The deployment active on one date, for driver code."""
    past = [d for d in deployments if d.effective_date <= as_of]
    return max(past, key=lambda d: d.effective_date) if past else None


def drift_records(scored: DataFrame, deployments=DEPLOYMENTS, date: str = "run_date") -> DataFrame:
    """Metrics per run next to the active model and its thresholds."""
    dated = with_active_deployment(scored, date, deployments)
    return dated.select(
        date,
        F.col("model").alias("active_model"),
        F.col("model_date").alias("active_model_date"),
        F.col("version").alias("active_model_version"),
        F.lit("recall").alias("active_metric_p0"),
        F.col("recall_threshold").alias("active_threshold_p0"),
        F.lit("f1").alias("active_metric_p1"),
        F.col("f1_threshold").alias("active_threshold_p1"),
        F.lit("gini").alias("active_metric_p2"),
        F.col("gini_threshold").alias("active_threshold_p2"),
        F.col("recall").alias("recall_score"),
        F.col("f1").alias("f1_score"),
        F.col("auc").alias("auc_score"),
        F.col("gini").alias("gini_score"),
    )


def register_rows(
    spark: SparkSession,
    run_date: str,
    model_type: str,
    label_version: str,
    model_params: dict,
    view_paths: dict[str, str],
    evaluation: DataFrame,
) -> DataFrame:
    """One register row from the metrics of ``scoring.evaluate`` (three rows at most)."""
    paths = [
        F.lit(view_paths.get(part)).alias(f"{part}_{side}_path")
        for part in ("train", "val", "test", "oot")
        for side in ("x", "y")
    ]
    scores = [
        F.max(F.when(F.col("split") == part, F.col(metric))).alias(f"{part}_{metric}")
        for part in ("train", "test", "oot")
        for metric in ("recall", "f1", "gini")
    ]
    return evaluation.agg(*scores).select(
        F.lit(run_date).cast("date").alias("run_date"),
        F.lit(model_type).alias("model_type"),
        F.lit(label_version).alias("label_version"),
        F.lit(json.dumps(model_params, sort_keys=True)).alias("model_params"),
        *paths,
        *[f"{part}_{metric}" for part in ("train", "test", "oot") for metric in ("recall", "f1", "gini")],
    )


def of_model_type(register: DataFrame, model_type: str) -> DataFrame:
    return register.where(F.col("model_type") == model_type)


def compare_model_types(register: DataFrame, types) -> DataFrame:
    """Out-of-time recall and F1 of each model type side by side per run date."""
    return register.groupBy("run_date").agg(
        *[
            F.max(F.when(F.col("model_type") == t, F.col(f"oot_{m}"))).alias(f"{t}_oot_{m}")
            for t in types
            for m in ("recall", "f1")
        ]
    )
