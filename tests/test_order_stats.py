import numpy as np
import pytest
from loanmart.operators.order_stats import approx_quantiles, exact_quantiles, order_statistics
from pyspark.sql import functions as F

PROBS = [0.0, 0.03, 0.1, 0.25, 0.5, 0.75, 0.97, 1.0]


def values(kind, n, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "continuous":
        return rng.normal(size=n) * 1e6
    if kind == "tied":
        return rng.integers(0, 4, size=n).astype(float)
    if kind == "third_equal":
        x = rng.exponential(size=n)
        x[: n // 3] = 0.5
        return x
    return np.full(n, 7.25)


@pytest.mark.parametrize("kind", ["continuous", "tied", "third_equal", "constant"])
@pytest.mark.parametrize("n", [10, 5_000])
def test_matches_numpy(spark, kind, n):
    x = values(kind, n)
    data = [(float(v),) for v in x] + [(None,)] * 100 + [(float("nan"),)] * 5
    df = spark.createDataFrame(data, "x double").repartition(6)
    got = exact_quantiles(df, {"x": PROBS})["x"]
    want = np.quantile(x, PROBS)
    assert np.allclose([got[p] for p in PROBS], want, rtol=1e-12, atol=1e-9)


def test_a_coarse_sketch_changes_nothing_on_longs_and_many_columns(spark):
    df = spark.range(20_000).select(
        F.xxhash64("id").alias("h"), (F.col("id") % 17).alias("m"), F.when(F.col("id") < 0, 1.0).alias("none")
    )
    ranks = [0, 1, 777, 10_000, 19_998, 19_999]
    targets = {"h": (F.col("h"), ranks), "m": (F.col("m"), ranks)}
    sizes = {"h": 20_000, "m": 20_000}
    narrow = order_statistics(df, targets, sizes, accuracy=100)
    assert narrow == order_statistics(df, targets, sizes)
    hashes = sorted(r["h"] for r in df.collect())
    assert narrow["h"] == {r: hashes[r] for r in ranks}
    assert exact_quantiles(df, {"none": [0.5], "m": [0.5]}) == {"none": {0.5: None}, "m": {0.5: 8.0}}


def test_one_row_and_sketch(spark):
    df = spark.createDataFrame([(4.0,)], "x double")
    assert exact_quantiles(df, {"x": [0.0, 0.3, 1.0]})["x"] == {0.0: 4.0, 0.3: 4.0, 1.0: 4.0}
    big = spark.range(10_001).select(F.col("id").cast("double").alias("x"))
    assert abs(approx_quantiles(big, {"x": [0.97]})["x"][0.97] - 9700) <= 2


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_columns_share_their_jobs(spark):
    # one partition: the sketch is exact, so one round settles every rank
    df = spark.range(3_000).coalesce(1).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double").alias(f"c{i}") for i in range(60)])
    few = jobs_of(spark, "few", lambda: exact_quantiles(df, {f"c{i}": [0.1, 0.5, 0.97] for i in range(5)}))
    many = jobs_of(spark, "many", lambda: exact_quantiles(df, {f"c{i}": [0.1, 0.5, 0.97] for i in range(60)}))
    assert few == many
