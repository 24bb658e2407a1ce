"""As-of joins against a plain search, and against the literal form."""

from bisect import bisect_right
from datetime import date, timedelta

import numpy as np
import pytest
from loanmart.operators import asof as A, registry as R
from pyspark.sql import functions as F

from conftest import rows

DAY = date(2020, 1, 1)


def plain(left, right):
    """(key, day, value) per left row; right rows in order, the greatest of equal times last."""
    by = {}
    for k, d, v in sorted((r for r in right if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)):
        by.setdefault(k, ([], []))[0].append(d)
        by[k][1].append((d, v))
    out = []
    for k, d in left:
        at = bisect_right(by[k][0], d) if k in by and d is not None else 0
        out.append((k, d, *(by[k][1][at - 1] if at else (None, None))))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("k", "day", "since", "v").collect()), key=str)


def test_against_a_plain_search(spark):
    rng = np.random.default_rng(4)
    key = lambda n: [None if x == 9 else "hot" if x < 4 else f"k{x}" for x in rng.integers(0, 10, n)]
    day = lambda n: [None if x == 0 else DAY + timedelta(days=int(x)) for x in rng.integers(0, 60, n)]
    left = [*zip(key(600), day(600)), ("absent", DAY), ("hot", DAY - timedelta(days=9))]
    left += left[:20]  # copies
    right = [*zip(key(300), day(300), [None if v == 0 else int(v) for v in rng.integers(0, 5, 300)])]
    a = spark.createDataFrame(left, "k string, day date").repartition(3)
    b = spark.createDataFrame(right, "k string, since date, v int").repartition(3)
    assert got(A.asof_join(a, b, ("day", "since"), ("k",))) == plain(left, right)


def test_empty_sides_and_names(spark):
    a = spark.createDataFrame([(1, DAY)], "k int, `a.day` date")
    b = spark.createDataFrame([], "k int, since date, v int")
    assert rows(A.asof_join(a, b, ("a.day", "since"), ("k",)).withColumnRenamed("a.day", "d")) == [(1, DAY, None, None)]
    assert A.asof_join(a.limit(0), b, ("a.day", "since"), ("k",)).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        A.asof_join(a, b.withColumnRenamed("v", "a.day"), ("a.day", "since"), ("k",))
    # columns named like the inner ones
    odd = spark.createDataFrame([(1, DAY, 5)], "k int, since date, _range int")
    assert A.asof_join(a, odd, ("a.day", "since"), ("k",)).first()["_range"] == 5


def test_equals_the_literal_form(spark):
    days = spark.range(0, 1500).select(F.date_add(F.lit("2023-06-01"), (F.col("id") % 700).cast("int")).alias("day"))
    history = spark.createDataFrame([(date.fromisoformat(d.effective_date), d.model) for d in R.DEPLOYMENTS], "model_date date, model string")
    joined = A.asof_join(days, history, ("day", "model_date"))
    literal = R.with_active_deployment(days, "day").select("day", "model_date", "model")
    assert rows(joined, "day", "model_date", "model") == rows(literal)


def test_many_deployments_and_a_hot_segment(spark):
    """100 000 deployments, a third of them and of the rows in one segment, found by arithmetic."""
    n = 100_000
    segment = lambda c: F.when(c % 3 == 0, F.lit(-1)).otherwise(c % 1000)
    right = spark.range(n).select(segment(F.col("id")).alias("s"), F.timestamp_seconds(F.col("id") * 10).alias("since"), F.col("id").alias("v"))
    left = spark.range(n).select(segment(F.col("id")).alias("s"), F.timestamp_seconds(F.col("id") * 10 + 5).alias("at"), F.col("id").alias("own"))
    found = A.asof_join(left, right, ("at", "since"), ("s",))
    assert found.where("v is distinct from own").count() == 0 and found.count() == n
    late = left.withColumn("at", F.timestamp_seconds(F.lit(n * 20))).where("s = -1")
    assert [r["v"] for r in A.asof_join(late, right, ("at", "since"), ("s",)).select("v").distinct().collect()] == [99_999]
