"""Scoring of the unlabelled rows with the model active on the run date."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ..operators import models as M, registry as R, scoring as Sc
from ..operators.boosting import BoostedModel
from ..sources.sinks import write_outbox, write_parquet
from .mart import Mart
from .training_month import load_encoders

LOADERS = {
    M.LOGISTIC: LogisticRegressionModel,
    M.SVM: LinearSVCModel,
}
PREDICTIONS = "customer_id string, loan_start_date date, prediction int"
MODEL_KINDS = {"lr_clf": M.LOGISTIC, "xgb_clf": M.BOOSTED, "svm_clf": M.SVM}


def score_month(
    spark: SparkSession, mart: Mart, run_date: str, deployments=R.DEPLOYMENTS
) -> DataFrame:
    """Predictions of a run, written to the outbox; none before the first deployment.

    The encoders are those stored with the active model, not the current month's.
    """
    active = R.model_on(run_date, deployments)
    if active is None:
        return spark.createDataFrame([], PREDICTIONS)
    kind = MODEL_KINDS[active.model]
    encoders = load_encoders(spark, mart, active.effective_date)
    trained_on = spark.read.parquet(mart.encoded("view", active.effective_date))
    columns = encoders.feature_columns(trained_on)
    path = mart.model(kind, active.effective_date)
    model = BoostedModel.load(spark, path) if kind == M.BOOSTED else LOADERS[kind].load(path)
    encoded = encoders.transform(spark.read.parquet(mart.inference(run_date)))
    write_parquet(encoded, mart.encoded("inference", run_date))
    predictions = Sc.score(model, spark.read.parquet(mart.encoded("inference", run_date)), columns)
    parquet, _ = write_outbox(predictions, mart.outbox, run_date)
    return spark.read.parquet(parquet)
