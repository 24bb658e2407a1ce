"""Raw files -> cleaned snapshots -> labels and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas as S
from ..operators import cleaning as C, features as Fe, labels as L, ledger as Lg, quality as Q
from ..schemas import raw_struct
from ..sources import raw, sinks, snapshots as Sn
from ..sources.publish import Limits
from ..functions.dates import is_first_of_month
from .mart import RAW_TABLES, Mart

CLEANERS = {
    "attributes": lambda df: C.dedup(C.clean_attributes(df)),
    "clickstream": lambda df: C.dedup(C.clean_clickstream(df)),
    "financials": lambda df: C.dedup(C.clean_financials(df)),
    "ledger": lambda df: Lg.with_days_past_due(C.clean_ledger(df)),
}


def raw_schema(table: str) -> T.StructType:
    """Stored raw rows: text, with the month as a date."""
    fields = [f for f in raw_struct(RAW_TABLES[table]) if f.name != Sn.PARTITION]
    return T.StructType([*fields, T.StructField(Sn.PARTITION, T.DateType())])


def _schema_of(plan: DataFrame) -> T.StructType:
    """Schema of a written plan: the month moves to the end as the partition column."""
    return plan.select(*[c for c in plan.columns if c != Sn.PARTITION], Sn.PARTITION).schema


def clean_schema(spark: SparkSession, table: str) -> T.StructType:
    return _schema_of(CLEANERS[table](spark.createDataFrame([], raw_schema(table))))


def feature_schema(spark: SparkSession) -> T.StructType:
    empty = {t: spark.createDataFrame([], clean_schema(spark, t)) for t in ("attributes", "financials")}
    return _schema_of(Fe.build_features(empty["attributes"], empty["financials"]))


def label_schema(spark: SparkSession) -> T.StructType:
    return _schema_of(L.default_labels(spark.createDataFrame([], clean_schema(spark, "ledger"))))


def ingest(spark: SparkSession, mart: Mart, files: dict[str, str], month: str | None = None) -> dict[str, int]:
    """Store raw rows by month as text; one month or a backfill of all of them.

    Rows whose month can't be read belong to no month: they go to the table's rejects, as they
    came, and their number is returned per table.
    """
    rejected = {}
    for table, path in files.items():
        text = raw.read_csv_text(spark, path, RAW_TABLES[table])
        month_of = F.col(Sn.PARTITION).try_cast("date")
        Sn.write_snapshots(text.where(month_of.isNotNull()).withColumn(Sn.PARTITION, month_of), mart.raw_snapshots(table), month)
        sinks.write_parquet(text.where(month_of.isNull()), mart.rejects(table))
        rejected[table] = spark.read.parquet(mart.rejects(table)).count()
    return rejected


def clean(spark: SparkSession, mart: Mart, month: str | None = None, limits: dict[str, Limits] | None = None) -> None:
    """Clean the stored months.

    With ``limits`` by table, a month that breaks them is not published (``AuditFailed``); this needs ``month``.  A row carries its month, so removing copies within a month equals removing
    them from the cumulative table and earlier months are never read again.
    """
    for table, cleaner in CLEANERS.items():
        df = Sn.read_snapshots(spark, mart.raw_snapshots(table), raw_schema(table))
        if month is not None:
            df = Sn.slice_month(df, month)
        Sn.write_snapshots(cleaner(df), mart.clean(table), month, audit=(limits or {}).get(table))
        _audit(spark, mart, table, df, month)


def _audit(spark: SparkSession, mart: Mart, table: str, raw_rows: DataFrame, month: str | None) -> None:
    """One record per table and month: copies removed, dates off the first of a month, NULLs per column."""
    rows = Sn.read_snapshots(spark, mart.clean(table), clean_schema(spark, table))
    if month is not None:
        rows = Sn.slice_month(rows, month)
    names = [c for c in rows.columns if c != Sn.PARTITION]
    nulls = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.count_if(F.col(c).isNull()) for c in names]))
    after = rows.groupBy(Sn.PARTITION).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~is_first_of_month(F.col(Sn.PARTITION))).alias("off_calendar"), nulls.alias("nulls")
    )
    before = raw_rows.groupBy(Sn.PARTITION).agg(F.count(F.lit(1)).alias("raw_rows"))
    record = after.join(before, Sn.PARTITION).select(
        Sn.PARTITION, "raw_rows", "rows", (F.col("raw_rows") - F.col("rows")).alias("copies"), "off_calendar", "nulls"
    )
    sinks.write_records(record, mart.audit(table), (Sn.PARTITION,))


def cleaned(spark: SparkSession, mart: Mart, table: str, as_of: str) -> DataFrame:
    """All cleaned rows of a table up to a month."""
    return Sn.up_to(Sn.read_snapshots(spark, mart.clean(table), clean_schema(spark, table)), as_of)


def build_gold(spark: SparkSession, mart: Mart, month: str | None = None, as_of: str | None = None) -> None:
    """Labels and features of one month, or of every month up to ``as_of``."""

    def rows(table: str) -> DataFrame:
        df = cleaned(spark, mart, table, month or as_of)
        return Sn.slice_month(df, month) if month else df

    Sn.write_snapshots(L.default_labels(rows("ledger")), mart.labels, month)
    features = Fe.build_features(rows("attributes"), rows("financials"))
    Sn.write_snapshots(features, mart.features, month)


def gold(spark: SparkSession, mart: Mart, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(features, labels) up to a month."""
    features = Sn.read_snapshots(spark, mart.features, feature_schema(spark))
    labels = Sn.read_snapshots(spark, mart.labels, label_schema(spark))
    return Sn.up_to(features, as_of), Sn.up_to(labels, as_of).select(*S.LABEL_COLUMNS)
