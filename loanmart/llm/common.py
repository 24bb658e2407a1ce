"""What several operators share: tables, sizes, ranks over all rows."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row below


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as tasks that know no Hadoop settings need it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return p.getFileSystem(conf).makeQualified(p).toString()


def open_store(uri: str):
    """(file system, path) of a qualified path, in a task."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the order of all rows.

    Rows are range-sorted and written; only one count per partition meets in one task.
    """
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_part", "_at", "_before")
    )


def smallest(df: DataFrame, n: int, *order: Column, fan_in: tuple[int, ...] = (1024, 32)) -> list:
    """The first n rows by the order; each task passes on at most n rows, and groups of tasks halve them on the way."""
    held = df.withColumn("_group", F.spark_partition_id())
    for groups in fan_in:
        held = held.withColumn("_group", F.pmod("_group", F.lit(groups)))
        held = held.withColumn("_nth", F.row_number().over(Window.partitionBy("_group").orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")
    # what is left is at most n rows of each of the last groups
    return held.drop("_group").orderBy(*order).limit(n).collect()
