"""Raw CSV scans. Schemas are declared, so no pass over the files infers types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import to_type
from ..schemas import raw_struct, struct

RESCUED, MALFORMED = "rescued", "malformed"


def read_csv_text(spark: SparkSession, path: str, names) -> DataFrame:
    """Every column as text; the header of each file is checked against ``names``."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(raw_struct(names)).csv(path)


def read_csv_typed(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Declared types; unreadable values are NULL (PERMISSIVE mode)."""
    return spark.read.option("header", True).schema(struct(columns)).csv(path)


def read_csv_rescued(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Declared types, and beside them what they lost.

    ``rescued`` holds an entry (column, text, reason) for every text without a value of its type (``unreadable``, the value is
    NULL) and for every fraction an integer drops (``truncated``).  ``malformed`` is the line of a record with too few or too
    many fields, else NULL; the fields it has are read.  Empty fields are NULL and lose nothing.
    """
    taken = {RESCUED, MALFORMED} & set(columns)
    if taken:
        raise ValueError(f"names of columns that are added: {sorted(taken)}")
    # a line's fields are counted only if none is pruned
    text = (
        spark.read.options(header=True, enforceSchema=False, mode="PERMISSIVE", columnPruning=False, columnNameOfCorruptRecord=MALFORMED)
        .schema(raw_struct([*columns, MALFORMED]))
        .csv(path)
    )
    typed = [to_type(F.col(c), kind).alias(c) for c, kind in columns.items()]
    lost = [_lost(c, kind) for c, kind in columns.items() if kind != "string"]
    # text alone loses nothing; the empty list still reads a column, as Spark refuses scans of malformed lines only
    entries = F.array_compact(F.array(*lost)) if lost else F.slice(F.array(_entry(next(iter(columns)), F.lit(""))), 1, 0)
    return text.select(*typed, entries.alias(RESCUED), MALFORMED)


def _entry(column: str, reason: Column) -> Column:
    return F.struct(F.lit(column).alias("column"), F.col(column).alias("text"), reason.alias("reason"))


def _lost(column: str, kind: str) -> Column:
    text = F.col(column)
    value = to_type(text, kind)
    reason = F.when(text.isNotNull() & value.isNull(), "unreadable")
    if kind == "int":
        reason = reason.when(text.try_cast("double") != value, "truncated")
    return F.when(reason.isNotNull(), _entry(column, reason))


def rescue_counts(df: DataFrame) -> DataFrame:
    """Losses of a rescued scan per column and reason, in one pass; malformed records count under no column as ``fields``."""
    record = F.when(
        F.col(MALFORMED).isNotNull(),
        F.array(F.struct(F.lit(None).cast("string").alias("column"), F.col(MALFORMED).alias("text"), F.lit("fields").alias("reason"))),
    )
    entries = F.concat(RESCUED, F.coalesce(record, F.array()))
    losses = df.select(F.explode(entries).alias("e")).select("e.column", "e.reason")
    return losses.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("n"))


def read_csv_header(spark: SparkSession, path: str) -> DataFrame:
    """All text with the header's own names, for files of unknown layout."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register_global_views(tables: dict[str, DataFrame]) -> None:
    """Name the frames for every session of the application (``global_temp.<name>``)."""
    for name, df in tables.items():
        df.createOrReplaceGlobalTempView(name)
