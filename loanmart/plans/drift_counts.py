"""Bin counts of scored months, kept for each model, and the reference population they are compared with.

A record is (model_date, date, feature, n, counts): a few numbers, whatever the size of the month.  Months are
counted when they are new or were written again; PSI, its history and the reports come from the records, and
counts of months add up to those of longer periods.  The reference is fitted once for a model and stored.

Records carry a stamp of the files they were made from (that of the reference, too).  A record whose stamp is no
longer that of its files is not read, so a month scored again or a model fitted again is counted again.  A month
without rows, or with NULLs only, has no records and no PSI.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import drift as D
from ..sources.sinks import write_parquet
from ..sources.snapshots import exists

_SCHEMA = "feature string, n long, counts array<long>, stamp string, model_date date, date date"


def stamp(spark: SparkSession, path: str) -> str:
    """Latest change, number and bytes of the files of a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return f"{max((f.getModificationTime() for f in files), default=0)}:{len(files)}:{sum(f.getLen() for f in files)}"


@dataclass(frozen=True)
class StoredReference:
    reference: D.Reference
    rows: int
    stamp: str


@dataclass(frozen=True)
class DriftCounts:
    """Records of one model, named by the date it is active from."""

    root: str
    model_date: str

    @property
    def _reference_path(self) -> str:
        return f"{self.root}/reference/model_date={self.model_date}"

    @property
    def _counts_path(self) -> str:
        return f"{self.root}/counts"

    def reference(self, spark: SparkSession, path: str, rows: DataFrame, features) -> StoredReference:
        """Edges and shares of ``rows``, which come from the files at ``path``; fitted where none are stored for these files."""
        now = stamp(spark, path)
        if exists(spark, f"{self._reference_path}/_SUCCESS"):
            table = spark.read.parquet(self._reference_path)
            head = table.select("stamp", "rows").first()
            if head is not None and head["stamp"] == now:
                return StoredReference(D.Reference.from_table(table), head["rows"], now)
        fitted, n = D.fit_reference(rows, features), rows.count()
        table = fitted.to_table(spark).withColumns({"rows": F.lit(n).cast("long"), "stamp": F.lit(now)})
        write_parquet(table.coalesce(1), self._reference_path)
        return StoredReference(fitted, n, now)

    def stored(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, self._counts_path):
            return spark.createDataFrame([], _SCHEMA)
        table = spark.read.schema(_SCHEMA).parquet(self._counts_path)
        return table.where(F.col("model_date") == F.lit(self.model_date).cast("date"))

    def update(self, spark: SparkSession, months: dict[str, str], reference: StoredReference) -> list[str]:
        """Count the months (date -> folder) without valid records, in one job; which ones these were."""
        expected = {d: self._month_stamp(spark, path, reference) for d, path in months.items()}
        known = {(str(r["date"]), r["stamp"]) for r in self.stored(spark).select("date", "stamp").distinct().collect()}
        new = [d for d, s in expected.items() if (d, s) not in known]
        if new:
            self.add(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
                spark.read.parquet(months[d]).withColumns({"date": F.lit(d).cast("date"), "stamp": F.lit(expected[d])}) for d in new
            ]), reference.reference)
        return new

    def add(self, rows: DataFrame, reference: D.Reference) -> None:
        """Records of all months of ``rows`` (which has ``date`` and ``stamp``) in place of earlier ones of these months."""
        counted = D.bin_counts(rows, reference.edges, ("date", "stamp"))
        record = counted.select("feature", "n", "counts", "stamp", F.lit(self.model_date).cast("date").alias("model_date"), "date")
        writer = record.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("model_date", "date").parquet(self._counts_path)

    def counts(self, spark: SparkSession, months: dict[str, str], reference: StoredReference) -> DataFrame:
        """Valid records of the months asked for."""
        valid = [(F.col("date") == F.lit(d).cast("date")) & (F.col("stamp") == self._month_stamp(spark, p, reference)) for d, p in months.items()]
        wanted = reduce(lambda a, b: a | b, valid, F.lit(False))
        return self.stored(spark).where(wanted).drop("stamp", "model_date")

    @staticmethod
    def _month_stamp(spark: SparkSession, path: str, reference: StoredReference) -> str:
        return f"{stamp(spark, path)}/{reference.stamp}"
