"""Monthly snapshot tables: one Parquet table per dataset, one partition per month.

A run replaces only the months it holds, so re-running a month is idempotent and
the history is never rewritten.  "All rows up to month d" is a read with a
partition filter.  ``rebalance`` lets AQE size the output files: a month that
holds most rows is split over many tasks, small months share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .publish import Audit, publish

PARTITION = "snapshot_date"


def write_snapshots(
    df: DataFrame, path: str, month: str | None = None, partition: str = PARTITION, audit: Audit | None = None
) -> None:
    """Replace the months present in ``df``; all others stay.

    With ``month`` only that month's rows are written and its folder is published as a whole, so a
    repeated run that finds no rows leaves none behind, and a lost one leaves those before.  ``audit``
    looks at a month before it is published and needs ``month``.
    """
    if audit is not None and month is None:
        raise ValueError("an audit needs a month")
    if month is None:
        _partitioned(df, partition).parquet(path)
    else:
        rows = slice_month(df, month, partition).drop(partition)
        publish(rows.hint("rebalance"), f"{path}/{partition}={month}", audit)


def write_snapshots_csv(df: DataFrame, path: str, partition: str = PARTITION) -> None:
    """Text copy of the snapshots, one folder per month."""
    _partitioned(df, partition).option("header", True).csv(path)


def _partitioned(df: DataFrame, partition: str):
    return (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
    )


def slice_month(df: DataFrame, month: str, partition: str = PARTITION) -> DataFrame:
    return df.where(F.col(partition) == F.lit(month).cast("date"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_snapshots(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The whole table; an absent one is empty when its schema is known."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def up_to(df: DataFrame, month: str, partition: str = PARTITION) -> DataFrame:
    """Cumulative snapshot: every month not after ``month`` (partition pruning on a stored table)."""
    return df.where(F.col(partition) <= F.lit(month).cast("date"))


def before(df: DataFrame, month: str, partition: str = PARTITION) -> DataFrame:
    """What the previous month's run had: everything up to one month before ``month``."""
    return df.where(F.col(partition) <= F.add_months(F.lit(month).cast("date"), -1))


def append_month(previous: DataFrame, current: DataFrame) -> DataFrame:
    """History plus the new month, matched by column name."""
    return previous.unionByName(current)
