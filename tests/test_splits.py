import math

import pytest
from loanmart.catalog.base import OOT_DATE, SPLIT_KEYS, Marts, with_split
from loanmart.operators import joins as J, splits as Sp
from loanmart.scratch import HUGE_METHOD, compiled_methods, stored
from pyspark.sql import functions as F

from conftest import rows


def frame(spark, n=3_000):
    return spark.range(n).select(
        F.concat(F.lit("L"), F.col("id")).alias("loan_id"),
        (F.col("id") % 7 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 10 == 0, "2024-12-01").otherwise("2024-06-01").cast("date").alias("label_snapshot_date"),
    )


def test_quotas_cover_and_stability(spark):
    df = frame(spark)
    split = Sp.assign_splits(df, "2024-12-01", ["loan_id"])
    got = rows(split, "loan_id", "split")
    assert len(got) == 3_000 and len({k for k, _ in got}) == 3_000
    again = Sp.assign_splits(df.repartition(13), "2024-12-01", ["loan_id"])
    assert rows(again, "loan_id", "split") == got
    for label in (0, 1):
        n = df.where(F.col("label") == label).where("label_snapshot_date <> date '2024-12-01'").count()
        test, valid = math.ceil(0.1 * n), math.ceil(0.2 * (n - math.ceil(0.1 * n)))
        counts = {r["split"]: r["count"] for r in split.where(F.col("label") == label).groupBy("split").count().collect()}
        assert counts["test"] == test and counts["valid"] == valid
        assert counts["train"] == n - test - valid
    assert split.where("split = 'oot'").count() == 300
    assert Sp.train_and_valid(split).count() == 3_000 - 300 - split.where("split = 'test'").count()


def test_copies_stay_together_and_single_row_class(spark):
    df = frame(spark, 200).where("label = 0").unionByName(frame(spark, 200).where("label = 0"))
    one = spark.createDataFrame([("only", 1)], "loan_id string, label int").withColumn(
        "label_snapshot_date", F.lit("2024-06-01").cast("date")
    )
    # one key holds a third of all rows
    hot = df.limit(1).select(F.lit("HOT").alias("loan_id"), F.lit(0).alias("label"), "label_snapshot_date")
    hot = hot.crossJoin(spark.range(170)).drop("id")
    all_rows = df.unionByName(one).unionByName(hot)
    split = Sp.assign_splits(all_rows, "2030-01-01", ["loan_id"])
    assert split.count() == all_rows.count()
    per_key = split.groupBy("loan_id").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert per_key == 1
    assert [r["split"] for r in split.where("loan_id = 'only'").collect()] == ["test"]


def test_folds_are_balanced_and_repeatable(spark):
    df = Sp.with_folds(frame(spark, 5_000), ["loan_id"])
    for label in (0, 1):
        counts = [r["count"] for r in df.where(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    again = Sp.with_folds(frame(spark, 5_000).repartition(7), ["loan_id"])
    assert rows(again, "loan_id", "fold") == rows(df, "loan_id", "fold")


def test_rows_without_month_or_label_or_after_the_run_month_are_in_no_split(spark):
    df = frame(spark, 900)
    odd = df.limit(100)
    undated = odd.withColumn("label_snapshot_date", F.lit(None).cast("date"))
    unlabelled = odd.withColumn("label", F.lit(None).cast("int"))
    later = odd.withColumn("label_snapshot_date", F.lit("2025-03-01").cast("date"))
    mixed = df.unionByName(undated).unionByName(unlabelled.where("label_snapshot_date < '2024-12-01'")).unionByName(later)
    got = Sp.assign_splits(mixed, "2024-12-01", ["loan_id"])
    assert rows(got, "loan_id", "split") == rows(Sp.assign_splits(df, "2024-12-01", ["loan_id"]), "loan_id", "split")


def test_split_by_a_stored_hash_is_the_same_and_is_not_computed_again(spark):
    df = frame(spark)
    hashed = stored(Sp.with_row_hash(df, ["loan_id"]))
    split = Sp.assign_splits(hashed, "2024-12-01", ["loan_id"], hashed=Sp.ROW_HASH).drop(Sp.ROW_HASH)
    assert split.columns == [*df.columns, "split"]
    assert rows(split) == rows(Sp.assign_splits(df, "2024-12-01", ["loan_id"]))
    assert "md5" not in split._jdf.queryExecution().optimizedPlan().toString()


def test_labelled_rows_are_written_with_their_hash(spark, folder):
    df = frame(spark, 500).withColumn("customer_id", F.lit("C")).withColumn("loan_start_date", F.lit("2000-01-01").cast("date"))
    df = df.withColumn("label_snapshot_date", F.lit("2000-03-01").cast("date"))
    split = with_split(Marts(spark, folder), df)
    assert "md5" not in split._jdf.queryExecution().optimizedPlan().toString()
    assert rows(split) == rows(Sp.assign_splits(df, OOT_DATE, SPLIT_KEYS))


def test_short_methods_only_while_tables_are_written(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(J, "stored", lambda df, name: seen.append(spark.conf.get(HUGE_METHOD)) or df)
    before = spark.conf.get(HUGE_METHOD)
    J.as_table(spark.range(3).distinct())
    assert seen == ["8000"] and spark.conf.get(HUGE_METHOD) == before
    spark.conf.set(HUGE_METHOD, "9000")
    try:
        with pytest.raises(ValueError), compiled_methods(spark):
            raise ValueError
        assert spark.conf.get(HUGE_METHOD) == "9000"
    finally:
        spark.conf.unset(HUGE_METHOD)
