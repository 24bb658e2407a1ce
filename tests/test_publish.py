"""Months are published whole and audited, or not at all."""

import os
from datetime import date

import pytest
from loanmart.plans import data_month as Dm
from loanmart.plans.mart import Mart
from loanmart.sources import publish as P, snapshots as Sn
from pyspark.sql import functions as F

from conftest import rows


def month(spark, values, day="2024-01-01"):
    return spark.createDataFrame([(v, date.fromisoformat(day)) for v in values], "k int, snapshot_date date")


def hidden(path):
    return [n for n in os.listdir(path) if n.startswith(".") and not n.endswith(".crc")]


def test_a_lost_write_leaves_the_rows_before(spark, folder):
    path = f"{folder}/t"
    Sn.write_snapshots(month(spark, [1, 2]), path, "2024-01-01")
    broken = month(spark, range(40)).repartition(8, "k").withColumn("k", F.when(F.col("k") == 33, F.raise_error("lost").cast("int")).otherwise(F.col("k")))
    with pytest.raises(Exception, match="lost"):
        Sn.write_snapshots(broken, path, "2024-01-01")
    assert rows(Sn.read_snapshots(spark, path), "k") == [(1,), (2,)]
    assert not hidden(path)
    Sn.write_snapshots(month(spark, [3]), path, "2024-01-01")
    Sn.write_snapshots(month(spark, [4], "2024-02-01"), path, "2024-02-01")
    assert rows(Sn.read_snapshots(spark, path), "k") == [(3,), (4,)]
    Sn.write_snapshots(month(spark, []), path, "2024-01-01")
    assert rows(Sn.read_snapshots(spark, path), "k") == [(4,)]


def test_a_month_may_be_made_from_itself(spark, folder):
    path = f"{folder}/t"
    Sn.write_snapshots(month(spark, [1, 2]), path, "2024-01-01")
    Sn.write_snapshots(Sn.read_snapshots(spark, path).withColumn("k", F.col("k") + 10), path, "2024-01-01")
    assert rows(Sn.read_snapshots(spark, path), "k") == [(11,), (12,)]


def test_a_driver_lost_between_the_renames(spark, folder):
    path = f"{folder}/m"
    P.publish(month(spark, [1]), path)
    before = f"{folder}/.before-m"
    os.rename(path, before)
    assert P.recover(spark, path) and rows(spark.read.parquet(path), "k") == [(1,)]
    # new rows in place, the ones before not deleted yet
    P.publish(month(spark, [2]), before)
    assert not P.recover(spark, path) and rows(spark.read.parquet(path), "k") == [(1,)] and not os.path.exists(before)
    os.rename(path, before)
    P.publish(month(spark, [3]), path)
    assert rows(spark.read.parquet(path), "k") == [(3,)] and not os.path.exists(before)


@pytest.mark.parametrize(
    "values, limits, problem",
    [
        ([1, None], P.Limits(keys=("k",)), "NULL in a key: 1 of 2"),
        ([1, None, 2], P.Limits(keys=("k",), null_keys=0.5), None),
        ([1, 1, 1, 2], P.Limits(copies=0.25), "copies: 2 of 4"),
        ([None, None], P.Limits(), "copies: 1 of 2"),
        ([], P.Limits(), None),
        ([], P.Limits(least_rows=1), "0 rows, fewer than 1"),
    ],
)
def test_audits(spark, folder, values, limits, problem):
    path = f"{folder}/m"
    P.publish(month(spark, [7]), path)
    if problem is None:
        P.publish(month(spark, values), path, limits)
    else:
        with pytest.raises(P.AuditFailed, match=problem):
            P.publish(month(spark, values), path, limits)
    kept = [7] if problem else values
    assert sorted(r["k"] or 0 for r in spark.read.parquet(path).collect()) == sorted(v or 0 for v in kept)
    assert not hidden(folder)


def test_the_calendar_and_the_month_of_an_audit(spark, folder):
    odd = month(spark, [1], "2024-01-02")
    with pytest.raises(P.AuditFailed, match="off the calendar: 1 of 1"):
        P.publish(odd, f"{folder}/m", P.Limits(date="snapshot_date"))
    assert not os.path.exists(f"{folder}/m")
    with pytest.raises(ValueError, match="needs a month"):
        Sn.write_snapshots(odd, f"{folder}/t", audit=P.Limits())


def test_the_monthly_job_keeps_a_month_that_breaks_its_limits(spark, folder, monkeypatch):
    mart, day = Mart(f"{folder}/mart"), "2024-01-01"
    monkeypatch.setattr(Dm, "CLEANERS", {"clickstream": Dm.CLEANERS["clickstream"]})
    raw = spark.createDataFrame([("a", day), (None, day)], "customer_id string, snapshot_date string")
    for f in Dm.raw_schema("clickstream").fields:
        if f.name not in raw.columns:
            raw = raw.withColumn(f.name, F.lit("1"))
    raw = raw.withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    Sn.write_snapshots(raw, mart.raw_snapshots("clickstream"), day)
    Dm.clean(spark, mart, day)
    assert Dm.cleaned(spark, mart, "clickstream", day).count() == 2
    Sn.write_snapshots(raw.where("customer_id is null"), mart.raw_snapshots("clickstream"), day)
    with pytest.raises(P.AuditFailed, match="NULL in a key: 1 of 1"):
        Dm.clean(spark, mart, day, limits={"clickstream": P.Limits(keys=("customer_id",))})
    assert Dm.cleaned(spark, mart, "clickstream", day).count() == 2
