from datetime import date

import pytest
from loanmart.operators import joins as J
from pyspark.sql import functions as F

from conftest import rows

KEYS = ("customer_id", "snapshot_date")


def sides(spark):
    d = date(2024, 1, 1)
    left = [("hot", d, f"l{i}") for i in range(50)] + [("only_left", d, "x"), (None, d, "n1"), ("n", None, "n2")]
    right = [("hot", d, "r1"), ("hot", d, "r2"), ("only_right", d, "y"), (None, d, "m1")]
    return (
        spark.createDataFrame(left, "customer_id string, snapshot_date date, a string").repartition(5),
        spark.createDataFrame(right, "customer_id string, snapshot_date date, b string").repartition(3),
    )


@pytest.mark.parametrize("how", ["left", "outer"])
def test_split_form_equals_plain_join(spark, how):
    left, right = sides(spark)
    want = rows(left.join(right, list(KEYS), how), "customer_id", "snapshot_date", "a", "b")
    got = rows(J.outer_join(left, right, KEYS, how), "customer_id", "snapshot_date", "a", "b")
    assert got == want
    swapped = J.outer_join(right, left, KEYS, how)
    assert rows(swapped, "customer_id", "snapshot_date", "a", "b") == rows(
        right.join(left, list(KEYS), how), "customer_id", "snapshot_date", "a", "b"
    )


def test_unmatched_keeps_null_keys(spark):
    left, right = sides(spark)
    got = rows(J.unmatched(left, right, KEYS), "a")
    assert got == [("n1",), ("n2",), ("x",)]


def test_inputs_are_computed_once(spark, folder):
    left, right = (df.dropDuplicates() for df in sides(spark))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = J.outer_join(left, right, KEYS)
        assert not J.is_scan(left)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # neither side's deduplication is left in the plan, and exchanges are shared by inner and anti parts
    assert "functions=[first" not in plan and "Scan ExistingRDD" not in plan
    assert "ReusedExchange" in plan
    assert "PushedFilters: [Or(IsNull(customer_id),IsNull(snapshot_date))]" in plan


def test_a_stored_input_is_not_written_again(spark, folder):
    left, _ = sides(spark)
    left.write.parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t").where("a > 'a'").select("customer_id", "a")
    assert J.is_scan(table) and J.as_table(table) is table


def test_skewed_partition_is_split_at_run_time(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 40_000
        left = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("a")
        )
        right = spark.range(0, n, 1, 8).select((F.col("id") - 1).alias("k"), F.md5(F.col("id").cast("string")).alias("b"))
        joined = J.outer_join(left, right, ["k"])
        assert len(joined.collect()) == left.join(right, ["k"], "outer").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin(skew=true)") == 2
        assert "ReusedExchange" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_label_join_ignores_label_month(spark):
    features = spark.createDataFrame(
        [("C1", date(2024, 1, 1), 1.0), ("C1", date(2024, 7, 1), 2.0), ("C2", date(2024, 1, 1), 3.0)],
        "customer_id string, snapshot_date date, x double",
    )
    labels = spark.createDataFrame(
        [("L1", "C1", date(2024, 1, 1), 1, "30dpd_6mob", date(2024, 7, 1))],
        "loan_id string, customer_id string, loan_start_date date, label int, label_def string, snapshot_date date",
    )
    both = J.attach_labels(features, labels)
    assert {r["x"]: (r["label"], r["label_snapshot_date"]) for r in both.collect()} == {
        1.0: (1, date(2024, 7, 1)),
        2.0: (None, None),
        3.0: (None, None),
    }
    assert [r["x"] for r in J.labelled_features(features, labels).collect()] == [1.0]
    assert sorted(r["x"] for r in J.unlabelled_features(features, labels).collect()) == [2.0, 3.0]
    # the exploratory variant joins on the label month instead
    same = J.snapshot_features_with_labels(features, labels)
    assert [r["x"] for r in same.where("label = 1").collect()] == [2.0]
