"""Deterministic stratified and out-of-time splits.

Rows are ordered by a seeded hash of their key within each label value; the
first 10 % are test, 20 % of the rest validation.  Finding the two hash values
where a class is cut is an order statistic (see ``order_stats``); applying them is
a projection, so no row is ranked, shuffled or moved.  Rows with equal keys
share a hash and stay together, so copies cannot end up on both sides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from .order_stats import order_statistics


def row_hash(keys, seed: int = S.SPLIT_SEED) -> Column:
    """First 52 bits of md5(key || seed): the same number on every engine and run."""
    joined = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint")


ROW_HASH = "_row_hash"


def with_row_hash(df: DataFrame, keys, seed: int = S.SPLIT_SEED) -> DataFrame:
    """The hash as a column, for rows that are stored: later passes read it instead of computing it."""
    return df.withColumn(ROW_HASH, row_hash(keys, seed))


@dataclass(frozen=True)
class ClassCut:
    label: object
    rows: int
    test_rows: int
    valid_rows: int
    test_hash: int | None
    valid_hash: int | None


def _hash(value: int | None) -> Column:
    return F.lit(value).cast("bigint")


@dataclass(frozen=True)
class SplitPlan:
    keys: tuple[str, ...]
    label: str
    seed: int
    cuts: tuple[ClassCut, ...]
    hashed: str | None = None  # column that holds the row hash

    def row_hash(self) -> Column:
        return F.col(self.hashed) if self.hashed else row_hash(self.keys, self.seed)

    def column(self) -> Column:
        """The split by one look-up of the class's cuts."""
        if not self.cuts:
            return F.lit("train")
        cuts = F.create_map(
            *[x for c in self.cuts for x in (F.lit(c.label), F.struct(_hash(c.test_hash).alias("test"), _hash(c.valid_hash).alias("valid")))]
        )
        h, cut = self.row_hash(), F.try_element_at(cuts, F.col(self.label))
        return F.when(h <= cut["test"], "test").when(h <= cut["valid"], "valid").otherwise("train")


def fit_split(
    df: DataFrame,
    keys,
    label: str = "label",
    test_share: float = S.TEST_SHARE,
    valid_share: float = S.VALID_SHARE,
    seed: int = S.SPLIT_SEED,
    max_classes: int | None = None,
    hashed: str | None = None,
) -> SplitPlan:
    """Quotas are ceil(test_share * n) and ceil(valid_share * rest) per label value.

    Classes are parameters on the driver; with ``max_classes`` a column of more values is refused.
    ``hashed`` names a column that holds the rows' hash (:func:`with_row_hash`).
    """
    keys = tuple(keys)
    h = F.col(hashed) if hashed else row_hash(keys, seed)
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    sizes = (counted.limit(max_classes + 1) if max_classes else counted).collect()
    if max_classes and len(sizes) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} values; it is not a class label")
    quotas, targets, counts = {}, {}, {}
    for row in sorted((r for r in sizes if r[label] is not None), key=lambda r: r[label]):
        n = row["n"]
        n_test = math.ceil(test_share * n)
        n_valid = math.ceil(valid_share * (n - n_test))
        name = str(row[label])
        quotas[name] = (row[label], n, n_test, n_valid)
        wanted = ([n_test - 1] if n_test else []) + ([n_test + n_valid - 1] if n_valid else [])
        targets[name] = (F.when(F.col(label) == F.lit(row[label]), h), wanted)
        counts[name] = n
    values = order_statistics(df, targets, counts)
    cuts = tuple(
        ClassCut(
            value,
            n,
            n_test,
            n_valid,
            values[name].get(n_test - 1) if n_test else None,
            values[name].get(n_test + n_valid - 1) if n_valid else None,
        )
        for name, (value, n, n_test, n_valid) in quotas.items()
    )
    return SplitPlan(keys, label, seed, cuts, hashed)


def is_out_of_time(as_of, column: str = "label_snapshot_date") -> Column:
    return F.col(column) == F.lit(as_of).cast("date")


def is_development(as_of, column: str = "label_snapshot_date", label: str = "label") -> Column:
    """Known before the run month; rows without a month or a label are in no split."""
    return (F.col(column) < F.lit(as_of).cast("date")) & F.col(label).isNotNull()


def development_rows(df: DataFrame, as_of, label: str = "label") -> DataFrame:
    return df.where(is_development(as_of, label=label))


def out_of_time_rows(df: DataFrame, as_of) -> DataFrame:
    return df.where(is_out_of_time(as_of))


def assign_splits(df: DataFrame, as_of, keys, label: str = "label", **options) -> DataFrame:
    """Rows up to the run month with ``split``: oot for that month, train / valid / test for earlier labels.

    Later rows, and rows without a label or its month, are left out.
    """
    plan = fit_split(development_rows(df, as_of, label), keys, label, **options)
    split = F.when(is_out_of_time(as_of), "oot").when(is_development(as_of, label=label), plan.column())
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def train_and_valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("split").isin("train", "valid"))


def with_folds(df: DataFrame, keys, label: str = "label", folds: int = 5, seed: int = S.SPLIT_SEED) -> DataFrame:
    """Add ``fold``: cross-validation folds of near equal size within every label value.

    The edges of a class's folds are order statistics of another hash than the split uses, so
    applying them is a projection; rows with equal keys share a fold.
    """
    keys = tuple(keys)
    h = row_hash(keys, seed + 1)
    sizes = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks = {v: [n * k // folds - 1 for k in range(1, folds) if n * k // folds] for v, n in sizes.items()}
    targets = {str(v): (F.when(F.col(label) == F.lit(v), h), ranks[v]) for v in sizes}
    values = order_statistics(df, targets, {str(v): n for v, n in sizes.items()})
    fold = F.lit(0)
    for v in sizes:
        edges = [values[str(v)][r] for r in ranks[v]]
        above = sum([(h > F.lit(e)).cast("int") for e in edges], F.lit(0))
        fold = F.when(F.col(label) == F.lit(v), above).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))
