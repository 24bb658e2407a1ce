"""Audits. Every audit is one aggregate over the table, whatever the number of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import is_first_of_month
from .order_stats import exact_quantiles


def null_audit(df: DataFrame, columns=None) -> DataFrame:
    """(column, nulls, rows) for each column, from a single pass."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return counted.unpivot(["rows"], columns, "column", "nulls").select("column", "nulls", "rows")


def duplicate_audit(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicates); copies are combined before the shuffle."""
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")
    ).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def calendar_audit(tables: dict[str, DataFrame], column: str = "snapshot_date") -> DataFrame:
    """(table, rows, violations): dates that are not the first of a month."""
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~is_first_of_month(F.col(column))).alias("violations"),
        ).select(F.lit(name).alias("table"), "rows", "violations")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def row_count(df: DataFrame, name: str = "rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def distinct_per_key(df: DataFrame, key: str, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(F.col(column)).alias(name))


def top_rows(df: DataFrame, score: str, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The n rows with the highest score (a top-k report); ties break on ``ties``."""
    return df.orderBy(F.col(score).desc(), *[F.col(t).asc() for t in ties]).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: repeatable on any partitioning."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(order, F.col(key)).limit(n)


def text_profile(df: DataFrame, columns) -> DataFrame:
    """(column, n, min, max) of text columns, in one aggregate."""
    columns = list(columns)
    row = df.agg(
        *[fn(F.col(c).cast("string")).alias(f"{name}_{c}") for c in columns for name, fn in (("n", F.count), ("min", F.min), ("max", F.max))]
    ).first()
    rows = [(c, row[f"n_{c}"], row[f"min_{c}"], row[f"max_{c}"]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, n bigint, min string, max string")


def profile(df: DataFrame, columns) -> DataFrame:
    """(column, n, mean, stddev, min, q25, q50, q75, max) with exact quartiles."""
    columns = list(columns)
    stats = df.agg(
        *[
            fn(F.col(c)).alias(f"{name}_{c}")
            for c in columns
            for name, fn in (("n", F.count), ("mean", F.avg), ("stddev", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    ).first()
    counts = {c: stats[f"n_{c}"] for c in columns}
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, counts)

    def number(v):
        return None if v is None else float(v)

    rows = [
        (
            c,
            counts[c],
            number(stats[f"mean_{c}"]),
            number(stats[f"stddev_{c}"]),
            number(stats[f"min_{c}"]),
            *[quartiles[c][p] for p in (0.25, 0.5, 0.75)],
            number(stats[f"max_{c}"]),
        )
        for c in columns
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, n bigint, mean double, stddev double, min double, q25 double, q50 double, q75 double, max double",
    )
