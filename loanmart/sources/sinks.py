"""Result sinks. All writes are parallel Spark writes; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .snapshots import exists


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_outbox(predictions: DataFrame, path: str, run_date: str) -> tuple[str, str]:
    """Predictions of a run as Parquet and CSV.

    The CSV is written from the stored Parquet, so the scoring plan runs once and
    both files hold the same rows.
    """
    parquet, csv = f"{path}/parquet/run_date={run_date}", f"{path}/csv/run_date={run_date}"
    write_parquet(predictions, parquet)
    write_csv(predictions.sparkSession.read.parquet(parquet), csv)
    return parquet, csv


def write_records(records: DataFrame, path: str, keys=("run_date",)) -> None:
    """Add records of a run to a record table; running again replaces them."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_records(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    if like is not None and not exists(spark, path):
        return like.limit(0)
    return spark.read.parquet(path)


def export_records(spark: SparkSession, path: str, target: str, sep: str = ",", order=("run_date",)) -> None:
    """The whole record table as one delimited text export."""
    table = spark.read.parquet(path)
    write_csv(table.orderBy(*[F.col(c) for c in order]), target, sep)
