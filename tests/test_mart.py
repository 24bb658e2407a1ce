"""The monthly jobs end to end, from CSV files to monitoring tables."""

from datetime import date

import pytest
from loanmart import schemas as S, scratch
from loanmart.fixtures import Tables
from loanmart.functions import numbers as N
from loanmart.operators import models as M, registry as R
from loanmart.plans import data_month as Dm, monitoring_month as Mm, scoring_month as Sm, training_month as Tm
from loanmart.plans.mart import Mart
from loanmart.sources import raw, sinks, snapshots as Sn
from pyspark.sql import functions as F

from conftest import rows

MONTHS = ("1997-01-01", "1997-02-01")
TABLES = {"attributes": "fx_att", "clickstream": "fx_cs", "financials": "fx_fin", "ledger": "fx_lms"}
COLUMNS = {"attributes": S.ATTRIBUTES, "clickstream": S.CLICKSTREAM, "financials": S.FINANCIALS, "ledger": S.LEDGER}


@pytest.fixture(scope="module")
def files(spark, data, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    t = Tables(spark, data)
    paths = {}
    for table, fixture in TABLES.items():
        paths[table] = f"{root}/{table}"
        sinks.write_csv(getattr(t, fixture).select(*COLUMNS[table]), paths[table])
    return paths


@pytest.fixture(scope="module")
def whole(spark, files, tmp_path_factory):
    """A mart with every month built at once."""
    mart = Mart(str(tmp_path_factory.mktemp("mart")))
    Dm.ingest(spark, mart, files)
    Dm.clean(spark, mart)
    Dm.build_gold(spark, mart, as_of="2001-12-01")
    return mart


def test_months_one_by_one_equal_all_at_once(spark, files, whole, folder):
    monthly = Mart(f"{folder}/monthly")
    for month in (*MONTHS, MONTHS[1]):  # the second month runs twice
        Dm.ingest(spark, monthly, files, month)
        Dm.clean(spark, monthly, month)
        Dm.build_gold(spark, monthly, month)
    for table in ("attributes", "financials", "ledger"):
        a = Dm.cleaned(spark, whole, table, MONTHS[-1]).where(F.col("snapshot_date") >= F.lit(MONTHS[0]).cast("date"))
        assert rows(Dm.cleaned(spark, monthly, table, MONTHS[-1])) == rows(a)
    for path in ("features", "labels"):
        a = spark.read.parquet(getattr(whole, path)).where(F.col("snapshot_date").isin(*map(date.fromisoformat, MONTHS)))
        b = spark.read.parquet(getattr(monthly, path))
        assert rows(b, *sorted(b.columns)) == rows(a, *sorted(b.columns))


@pytest.fixture(scope="module")
def trained(spark, whole):
    mart = whole
    deployments = (R.Deployment("2000-01-01", "lr_clf"),)
    for run in ("2000-01-01", "2000-02-01"):
        Tm.build_views(spark, mart, run)
    Tm.fit_and_encode(spark, mart, "2000-01-01")
    space = {"C": [0.1, 1.0], "penalty": ["l2"], "max_iter": [10]}
    result = Tm.train(spark, mart, "2000-01-01", M.LOGISTIC, draws=2, folds=2, space=space)
    return mart, deployments, result


def test_training_and_register(spark, trained):
    mart, _, result = trained
    view = Tm.split_view(spark, mart, "2000-01-01")
    counts = {r["split"]: r["count"] for r in view.groupBy("split").count().collect()}
    assert set(counts) == {"train", "valid", "test", "oot"}
    assert view.where("split = 'oot'").select("label_snapshot_date").distinct().first()[0] == date(2000, 1, 1)
    assert view.agg(F.max("label_snapshot_date")).first()[0] == date(2000, 1, 1)
    register = spark.read.parquet(mart.register)
    assert register.count() == 1
    row = R.of_model_type(register, M.LOGISTIC).first()
    evaluation = {r["split"]: r for r in result.evaluation.collect()}
    assert row["train_recall"] == pytest.approx(evaluation["train"]["recall"])
    assert row["oot_gini"] == pytest.approx(evaluation["oot"]["gini"])
    exported = spark.read.option("header", True).option("sep", "|").csv(mart.export("register"))
    assert exported.count() == 1 and "model_params" in exported.columns


def test_audits_and_rejects(spark, files, whole, folder):
    audit = {r["snapshot_date"]: r for r in spark.read.parquet(whole.audit("financials")).collect()}
    table = spark.read.parquet(whole.clean("financials"))
    assert sum(r["rows"] for r in audit.values()) == table.count()
    assert sum(r["raw_rows"] for r in audit.values()) == spark.read.parquet(whole.raw_snapshots("financials")).count()
    assert all(r["copies"] >= 0 and r["off_calendar"] == 0 for r in audit.values())
    assert sum(r["nulls"]["annual_income"] for r in audit.values()) == table.where("annual_income is null").count()
    odd = Mart(f"{folder}/odd")
    text = raw.read_csv_text(spark, files["ledger"], S.LEDGER)
    sinks.write_csv(text.limit(50).withColumn("snapshot_date", F.lit("no month")).unionByName(text.limit(70)), f"{folder}/ledger")
    assert Dm.ingest(spark, odd, {"ledger": f"{folder}/ledger"}) == {"ledger": 50}
    assert spark.read.parquet(odd.rejects("ledger")).where("snapshot_date = 'no month'").count() == 50
    assert spark.read.parquet(odd.raw_snapshots("ledger")).count() == 70


def test_nothing_is_left_after_clearing(spark):
    jvm = spark.sparkContext._jvm
    scratch.stored(spark.range(3))
    folder = jvm.org.apache.hadoop.fs.Path(scratch.scratch_folder(spark))
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert store.exists(folder) and scratch.clear(spark) and not store.exists(folder)


def test_a_nan_is_no_value(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("x",), (None,)], "a string")
    assert [r["a"] for r in df.select(N.to_type(F.col("a"), "double").alias("a")).collect()] == [1.5, None, None, None]


def test_scoring_and_monitoring(spark, trained):
    mart, deployments, _ = trained
    assert Sm.score_month(spark, mart, "1999-12-01", deployments).count() == 0
    assert Mm.monitor_feature_drift(spark, mart, "1999-12-01", [], deployments)["psi"].count() == 0
    for run in ("2000-01-01", "2000-02-01"):
        predictions = Sm.score_month(spark, mart, run, deployments)
        assert predictions.count() == spark.read.parquet(mart.inference(run)).count() > 0
        csv = raw.read_csv_header(spark, f"{mart.outbox}/csv/run_date={run}")
        assert csv.count() == predictions.count()
        rates = Mm.monitor_rates(spark, mart, run)
    rates = Mm.monitor_rates(spark, mart, "2000-02-01")  # again: still one record per run
    assert rates.count() == 2
    none = Mm.monitor_concept_drift(spark, mart, "2000-01-01", deployments)
    assert none.count() == 0
    drift = Mm.monitor_concept_drift(spark, mart, "2000-02-01", deployments)
    assert [r["active_model"] for r in drift.collect()] == ["lr_clf"]
    assert {"recall_below", "f1_below", "gini_below"} <= set(drift.columns) and set(none.columns) == set(drift.columns)
    for record, n in (("result_rates", 2), ("concept_drift", 1)):
        assert raw.read_csv_header(spark, mart.export(record)).count() == n
    tables = Mm.monitor_feature_drift(spark, mart, "2000-02-01", ["2000-01-01", "2000-02-01"], deployments)
    assert tables["overall"].count() == 2
    assert tables["summary"].first()["records"] == 2
    view = Tm.split_view(spark, mart, "2000-01-01")
    assert tables["summary"].first()["reference_rows"] == view.where("split in ('train', 'valid')").count()
    assert tables["average_by_feature"].count() >= 30
    assert Mm.previous_run("2024-01-01") == "2023-12-01" and Mm.previous_run("2024-12-01") == "2024-11-01"


def test_snapshot_reads(spark, folder):
    df = spark.sql(
        "select id as k, add_months(date '2024-01-01', cast(id % 4 as int)) as snapshot_date from range(20)"
    )
    path = f"{folder}/t"
    schema = df.schema
    assert Sn.read_snapshots(spark, path, schema).count() == 0
    Sn.write_snapshots(df, path)
    table = Sn.read_snapshots(spark, path)
    assert Sn.up_to(table, "2024-02-01").count() == 10
    assert Sn.before(table, "2024-02-01").count() == 5
    assert Sn.before(table, "2024-01-01").count() == 0
    assert "PartitionFilters: [isnotnull(snapshot_date" in Sn.up_to(table, "2024-02-01")._jdf.queryExecution().executedPlan().toString()
    union = Sn.append_month(Sn.before(table, "2024-02-01"), Sn.slice_month(table, "2024-02-01"))
    assert rows(union) == rows(Sn.up_to(table, "2024-02-01"))


def test_records_and_missing_table(spark, folder):
    df = spark.sql("select date '2024-01-01' as run_date, 1 as n")
    assert sinks.read_records(spark, f"{folder}/none", df).count() == 0
    sinks.write_records(df, f"{folder}/r")
    sinks.write_records(df.withColumn("n", F.lit(2)), f"{folder}/r")
    assert rows(sinks.read_records(spark, f"{folder}/r"), "n") == [(2,)]
