"""Views, encoders and models of a training month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import encoders as E, joins as J, models as M, registry as R, scoring as Sc, splits as Sp
from ..operators.labels import label_definition
from ..sources.sinks import export_records, write_parquet, write_records
from .data_month import gold
from .mart import Mart

SPLIT_KEYS = ("loan_id", "customer_id", "loan_start_date")


def build_views(spark: SparkSession, mart: Mart, run_date: str) -> None:
    """Labelled rows with their split, and the unlabelled rows to score.

    The joined rows are written once; the split is fitted and applied on the
    written table, so the join is not repeated for each statistic.
    """
    features, labels = gold(spark, mart, run_date)
    joined = f"{mart.view(run_date)}/joined"
    write_parquet(J.labelled_features(features, labels), joined)
    rows = spark.read.parquet(joined)
    write_parquet(Sp.assign_splits(rows, run_date, SPLIT_KEYS), f"{mart.view(run_date)}/split")
    write_parquet(J.unlabelled_features(features, labels), mart.inference(run_date))


def split_view(spark: SparkSession, mart: Mart, run_date: str) -> DataFrame:
    return spark.read.parquet(f"{mart.view(run_date)}/split")


def fit_and_encode(
    spark: SparkSession, mart: Mart, run_date: str, spec: E.EncoderSpec = E.EncoderSpec()
) -> E.FittedEncoders:
    """Fit on train, store the parameters, store the encoded view."""
    view = split_view(spark, mart, run_date)
    fitted = E.fit_encoders(view.where("split = 'train'"), spec)
    write_parquet(fitted.to_table(spark).coalesce(1), mart.encoder_params(run_date))
    write_parquet(fitted.transform(view), mart.encoded("view", run_date))
    return load_encoders(spark, mart, run_date)


def load_encoders(spark: SparkSession, mart: Mart, run_date: str) -> E.FittedEncoders:
    return E.FittedEncoders.from_table(spark.read.parquet(mart.encoder_params(run_date)))


@dataclass
class Trained:
    search: M.SearchResult
    features: list[str]
    evaluation: DataFrame


def train(
    spark: SparkSession,
    mart: Mart,
    run_date: str,
    kind: str,
    draws: int = M.SEARCH_DRAWS,
    folds: int = M.SEARCH_FOLDS,
    space: dict | None = None,
    parallelism: int = 4,
) -> Trained:
    """Search, save the winner, evaluate it and add its register row."""
    encoded = spark.read.parquet(mart.encoded("view", run_date))
    columns = load_encoders(spark, mart, run_date).feature_columns(encoded)
    training, sizes = M.prepare_training(Sp.train_and_valid(encoded), columns, SPLIT_KEYS, folds)
    training.persist()
    try:
        search = M.random_search(kind, training, sizes, draws, folds, space, parallelism)
    finally:
        training.unpersist()
    if kind == M.BOOSTED:
        search.model.save(spark, mart.model(kind, run_date))
    else:
        search.model.write().overwrite().save(mart.model(kind, run_date))
    evaluation = Sc.evaluate(search.model, encoded, columns)
    path = mart.encoded("view", run_date)
    row = R.register_rows(
        spark,
        run_date,
        kind,
        label_definition(),
        search.best,
        {part: path for part in ("train", "val", "test", "oot")},
        evaluation,
    )
    write_records(row, mart.register, ("run_date", "model_type"))
    export_records(spark, mart.register, mart.export("register"), sep="|", order=("run_date", "model_type"))
    return Trained(search, columns, evaluation)
