"""Publish a folder only when it is whole and passes its audit.

Rows are written beside their place, into a hidden folder no reader lists, read back and audited there, and then put in
place by renames: the folder before goes aside, the new one comes in, the one before is deleted.  A job lost while it
writes, or an audit that fails, leaves the rows before as they were.  A driver lost between the two renames leaves the
folder before aside; the next publish of this folder, or :func:`recover`, puts it back.

Renames are cheap on file systems with folders (HDFS); on object stores they copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import is_first_of_month

Audit = Callable[[DataFrame], list[str]]


class AuditFailed(ValueError):
    """Rows that were not published, and why."""


@dataclass(frozen=True)
class Limits:
    """What a month may hold: shares of rows with a NULL among ``keys``, of whole-row copies, and off the first of a month in ``date``."""

    keys: tuple[str, ...] = ()
    null_keys: float = 0.0
    copies: float = 0.0
    date: str | None = None
    off_calendar: float = 0.0
    least_rows: int = 0

    def __call__(self, rows: DataFrame) -> list[str]:
        """Problems found, in two aggregates; copies are told by two 64-bit hashes of all columns."""
        of = [f"`{c}`" for c in rows.columns]
        null = F.lit(False)
        for k in self.keys:
            null = null | F.col(f"`{k}`").isNull()
        off = ~is_first_of_month(F.col(f"`{self.date}`")) if self.date else F.lit(False)
        marked = rows.select(
            F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b"), null.cast("long").alias("null"), off.cast("long").alias("off")
        )
        each = marked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("null").alias("null"), F.sum("off").alias("off"))
        found = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "null", "off")], F.count(F.lit(1)).alias("different")).first()
        n = found["n"]
        problems = [
            f"{name}: {got} of {n} rows"
            for name, got, most in (
                ("NULL in a key", found["null"], self.null_keys),
                ("copies", n - found["different"], self.copies),
                ("off the calendar", found["off"], self.off_calendar),
            )
            if got > most * n
        ]
        return problems + ([f"{n} rows, fewer than {self.least_rows}"] if n < self.least_rows else [])


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _aside(path: str) -> tuple[str, str]:
    parent, name = path.rstrip("/").rsplit("/", 1)
    return f"{parent}/.staged-{uuid.uuid4().hex}", f"{parent}/.before-{name}"


def recover(spark: SparkSession, path: str) -> bool:
    """Put the folder before back where a publish was lost between its renames."""
    fs, place = _at(spark, path)
    _, before = _at(spark, _aside(path)[1])
    if not fs.exists(before):
        return False
    if fs.exists(place):
        fs.delete(before, True)  # the new rows were in place already
        return False
    return fs.rename(before, place)


def publish(df: DataFrame, path: str, audit: Audit | None = None) -> None:
    """Replace the folder at ``path`` by the rows of ``df``; raises :class:`AuditFailed` and changes nothing where the audit finds problems."""
    spark = df.sparkSession
    recover(spark, path)
    staged_path, before_path = _aside(path)
    fs, staged = _at(spark, staged_path)
    try:
        df.write.parquet(staged_path)
        problems = audit(spark.read.schema(df.schema).parquet(staged_path)) if audit else []
        if problems:
            raise AuditFailed(f"{path}: {'; '.join(problems)}")
        place, before = _at(spark, path)[1], _at(spark, before_path)[1]
        replaced = fs.exists(place)
        fs.mkdirs(place.getParent())
        if replaced and not fs.rename(place, before):
            raise OSError(f"{path} can't be moved aside")
        if not fs.rename(staged, place):
            raise OSError(f"{path} can't be put in place")
        if replaced:
            fs.delete(before, True)
    finally:
        recover(spark, path)
        if fs.exists(staged):
            fs.delete(staged, True)
