"""Batch scoring and evaluation of fitted models."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F

from .compiled import compile_model
from .metrics import evaluation_by_split
from .models import assemble

PREDICTION_KEYS = ("customer_id", "loan_start_date")


def score(model: Model, encoded: DataFrame, features: list[str], keep=PREDICTION_KEYS) -> DataFrame:
    """Hard predictions next to the ids they belong to; a projection of the input.

    Models that compile are column expressions (NULL where a row lacks a column they read); the rest transform vectors.
    """
    compiled = compile_model(model, features)
    if compiled is not None:
        return encoded.select(*keep, compiled.prediction().alias("prediction"))
    scored = model.transform(assemble(encoded, features))
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"))


def prediction_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def evaluate(model: Model, encoded: DataFrame, features: list[str]) -> DataFrame:
    """recall / f1 / gini / accuracy for train (with valid), test and oot rows."""
    return evaluation_by_split(score(model, encoded, features, keep=("split", "label")))
