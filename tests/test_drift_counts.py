"""PSI from stored counts: equal to that of the rows, and no month is read twice."""

from datetime import date
from types import SimpleNamespace

import pytest
from loanmart.operators import drift as D, registry as R
from loanmart.plans import monitoring_month as Mm
from loanmart.plans.drift_counts import DriftCounts
from loanmart.plans.mart import Mart
from pyspark.sql import functions as F

NAMES = ("x", "y")
MONTHS = ("2024-01-01", "2024-02-01", "2024-03-01")


def frame(spark, seed, n=400):
    return spark.range(n).select(
        (F.rand(seed) * (1 + seed / 10)).alias("x"), (F.col("id") * (seed + 3) % 7).cast("double").alias("y"), F.lit(None).cast("double").alias("z")
    )


@pytest.fixture()
def months(spark, folder):
    paths = {d: f"{folder}/months/{d}" for d in MONTHS}
    for i, path in enumerate(paths.values()):
        frame(spark, i + 1).write.parquet(path)
    frame(spark, 0, 900).write.parquet(f"{folder}/view")
    return paths


def psi(counted, reference):
    return {(str(r["date"]), r["feature"]): r["psi"] for r in D.psi_of_counts(counted, reference, ("date",)).collect()}


def of_rows(spark, months, reference):
    out = {}
    for d, path in months.items():
        rows = spark.read.parquet(path).withColumn("date", F.lit(d).cast("date"))
        out |= {(str(r["date"]), r["feature"]): r["psi"] for r in D.feature_psi(rows, reference, ("date",)).collect()}
    return out


def test_a_month_is_counted_once(spark, folder, months):
    store, view = DriftCounts(f"{folder}/drift", "2024-01-01"), f"{folder}/view"
    kept = store.reference(spark, view, spark.read.parquet(view), (*NAMES, "z"))
    assert kept.rows == 900 and set(kept.reference.edges) == set(NAMES)
    first = {d: months[d] for d in MONTHS[:2]}
    assert store.update(spark, first, kept) == [*MONTHS[:2]] and store.update(spark, first, kept) == []
    # of three months asked for, only the new one is scanned
    assert store.update(spark, months, kept) == [MONTHS[2]]
    assert psi(store.counts(spark, months, kept), kept.reference) == pytest.approx(of_rows(spark, months, kept.reference))
    assert {d for d, _ in psi(store.counts(spark, first, kept), kept.reference)} == set(MONTHS[:2])
    assert store.counts(spark, {}, kept).count() == 0


def test_changed_files_are_counted_again(spark, folder, months):
    store, view = DriftCounts(f"{folder}/drift", "2024-01-01"), f"{folder}/view"
    kept = store.reference(spark, view, spark.read.parquet(view), NAMES)
    again = store.reference(spark, view, spark.read.parquet(view).where("false"), NAMES)
    assert again == kept  # read back, not fitted
    store.update(spark, months, kept)
    frame(spark, 9, 50).write.mode("overwrite").parquet(months[MONTHS[1]])
    assert MONTHS[1] not in {d for d, _ in psi(store.counts(spark, months, kept), kept.reference)}
    assert store.update(spark, months, kept) == [MONTHS[1]]
    assert psi(store.counts(spark, months, kept), kept.reference) == pytest.approx(of_rows(spark, months, kept.reference))
    # an empty month has no records, nor have those before its change
    frame(spark, 9, 50).where("false").write.mode("overwrite").parquet(months[MONTHS[1]])
    store.update(spark, months, kept)
    assert {d for d, _ in psi(store.counts(spark, months, kept), kept.reference)} == {MONTHS[0], MONTHS[2]}
    # another reference makes all records invalid
    frame(spark, 5, 300).write.mode("overwrite").parquet(view)
    new = store.reference(spark, view, spark.read.parquet(view), NAMES)
    assert new.rows == 300 and store.counts(spark, months, new).count() == 0
    assert set(store.update(spark, months, new)) == set(MONTHS)
    assert psi(store.counts(spark, months, new), new.reference) == pytest.approx(of_rows(spark, months, new.reference))


def test_counts_add_up(spark, folder, months):
    reference = D.fit_reference(frame(spark, 0, 900), NAMES)
    every = None
    for d, path in months.items():
        rows = spark.read.parquet(path).withColumn("date", F.lit(d).cast("date"))
        every = rows if every is None else every.unionByName(rows)
    parts = D.bin_counts(every, reference.edges, ("date",))
    whole = {r["feature"]: (r["n"], r["counts"]) for r in D.bin_counts(every, reference.edges).collect()}
    assert {r["feature"]: (r["n"], r["counts"]) for r in D.merged_counts(parts).collect()} == whole


def test_models_apart_and_columns_missing(spark, folder, months):
    view = f"{folder}/view"
    spark.read.parquet(months[MONTHS[0]]).drop("y").write.parquet(f"{folder}/narrow")
    some = {MONTHS[0]: f"{folder}/narrow", MONTHS[1]: months[MONTHS[1]]}
    for model in ("2023-01-01", "2024-01-01"):
        store = DriftCounts(f"{folder}/drift", model)
        kept = store.reference(spark, view, spark.read.parquet(view), NAMES)
        assert len(store.update(spark, some, kept)) == 2
        found = psi(store.counts(spark, some, kept), kept.reference)
        assert set(found) == {(MONTHS[0], "x"), (MONTHS[1], "x"), (MONTHS[1], "y")}
    assert {r["model_date"] for r in spark.read.parquet(f"{folder}/drift/counts").select("model_date").distinct().collect()} == {date(2023, 1, 1), date(2024, 1, 1)}


def test_the_monthly_job_reads_only_new_months(spark, folder, months, monkeypatch):
    mart, run = Mart(f"{folder}/mart"), MONTHS[0]
    view = frame(spark, 0, 900).withColumn("split", F.when(F.col("y") < 2, "test").when(F.col("y") < 4, "valid").otherwise("train"))
    view.write.parquet(mart.encoded("view", run))
    for d in MONTHS:
        spark.read.parquet(months[d]).write.parquet(mart.encoded("inference", d))
    monkeypatch.setattr(Mm, "load_encoders", lambda *_: SimpleNamespace(feature_columns=lambda df: list(NAMES)))
    scanned = []
    add = DriftCounts.add
    monkeypatch.setattr(DriftCounts, "add", lambda self, rows, reference: (scanned.append(len(rows.inputFiles())), add(self, rows, reference))[1])
    deployments = (R.Deployment(run, "lr_clf"),)
    for n in (2, 3):
        tables = Mm.monitor_feature_drift(spark, mart, MONTHS[n - 1], MONTHS[:n], deployments)
        assert tables["overall"].count() == n
    assert scanned == [sum(len(spark.read.parquet(mart.encoded("inference", d)).inputFiles()) for d in part) for part in (MONTHS[:2], MONTHS[2:])]
    reference = D.fit_reference(view.where("split in ('train', 'valid')"), NAMES)
    assert {(str(r["date"]), r["feature"]): r["psi"] for r in tables["psi"].collect()} == pytest.approx(of_rows(spark, months, reference))
    assert tables["summary"].first()["reference_rows"] == view.where("y >= 2").count()
