"""Trees are fitted on all rows, however many there are."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from loanmart.catalog import modelling
from loanmart.catalog.base import Marts
from loanmart.operators import boosting as B, models as M, order_stats as O
from loanmart.scratch import stored


def table(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(0, 1, n), rng.integers(0, 4, n), np.ones(n), rng.normal(0, 2, n).round(1), rng.random(n) < 0.3]
    y = (1.5 * x[:, 0] - x[:, 4] + 0.4 * x[:, 1] + rng.normal(0, 1, n) > 0.8).astype(float)
    return x, y, rng.integers(0, 3, n)


def frame(spark, x, y, fold):
    kind = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("features", VectorUDT())])
    rows = [(int(b), int(f), Vectors.dense(a)) for a, b, f in zip(x.tolist(), y, fold)]
    return stored(spark.createDataFrame(rows, kind).repartition(3))


@pytest.fixture(scope="module")
def rows(spark):
    x, y, fold = table(3000)
    return x, y, fold, B.binned(frame(spark, x, y, fold))


def test_order_statistics_of_arrays(spark, monkeypatch):
    monkeypatch.setattr(O, "ARRAY_VALUES", 40)
    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(size=4000), rng.integers(0, 3, 4000), np.exp(9 * rng.normal(size=4000)), rng.integers(0, 500, 4000) // 400 * rng.random(4000)]
    ranks = [0, 17, 1999, 3200, 3999]
    found = O.array_order_statistics(spark.createDataFrame([(a,) for a in x.tolist()], "x array<double>").repartition(4), "x", 4, ranks, 4000, few=10)
    assert [few for few, _ in found] == [False, True, False, False]
    assert list(found[1][1].values()) == [0, 1, 2]
    for k in (0, 2, 3):
        assert found[k][1] == dict(zip(ranks, np.sort(x[:, k])[ranks]))


def test_a_table_of_rows_has_the_bins_of_the_same_rows_in_one_place(rows):
    x, y, fold, data = rows
    want = B.Binned.of(x, y, fold)
    assert all(np.array_equal(a, b) for a, b in zip(data.edges, want.edges)) and len(data.edges) == 5
    got = data.gathered()
    order = np.lexsort((*want.bins.T[::-1], fold, y))
    assert np.array_equal(got.bins, want.bins[order]) and np.array_equal(got.label, y[order]) and np.array_equal(got.fold, fold[order])


@pytest.mark.parametrize("s", [
    B.Setting(n_estimators=4, max_depth=3, learning_rate=0.3),
    B.Setting(n_estimators=3, max_depth=5, learning_rate=0.2, colsample=0.6, gamma=1.0, reg_alpha=0.7, min_child_weight=3, weight_factor=2.0),
])
def test_trees_of_a_table_are_those_of_the_same_rows_in_one_place(rows, s, monkeypatch):
    x, y, fold, data = rows
    monkeypatch.setattr(B, "KEPT_TREES", 2)
    monkeypatch.setattr(B, "CELLS", 400)
    if s.colsample < 1:
        drawn = iter([np.array(p) for p in ([0, 1, 4, 3, 2], [2, 3, 1, 0, 4], [4, 0, 3, 2, 1])])
        fixed = type("Fixed", (), {"permutation": lambda self, d: next(drawn), "integers": lambda self, n: 0, "random": lambda self, n: np.zeros(n)})
        monkeypatch.setattr(np.random, "default_rng", lambda seed: fixed())
    got = B.fit_rows(data, s).trees.margin(x)
    if s.colsample < 1:
        drawn = iter([np.array(p) for p in ([0, 1, 4, 3, 2], [2, 3, 1, 0, 4], [4, 0, 3, 2, 1])])
    one = B.Binned.of(x, y, fold)
    assert np.allclose(got, B.boost(one, np.ones(len(y), dtype=bool), s)[1], atol=1e-6)


def test_rows_of_a_tree_are_drawn_anew_for_each(rows):
    x, y, _, data = rows
    margin = B.fit_rows(data, B.Setting(n_estimators=6, max_depth=3, subsample=0.5)).trees.margin(x)
    assert ((margin > 0) == (y == 1)).mean() > 0.8
    place = np.arange(20_000) * 7919
    one, other = B._uniform(place, 1) < 0.5, B._uniform(place, 2) < 0.5
    assert abs(one.mean() - 0.5) < 0.02 and abs((one & other).mean() - 0.25) < 0.02


def test_no_rows_and_rows_of_one_class(spark):
    x, y, fold = table(50)
    none = B.binned(frame(spark, x, y, fold).where("false"))
    assert len(B.fit_rows(none, B.Setting(n_estimators=2)).trees.start) == 2
    ones = B.binned(frame(spark, x, np.ones(50), fold))
    assert (B.fit_rows(ones, B.Setting(n_estimators=2)).trees.margin(x) >= 0).all()


def test_more_rows_than_a_sample_held_are_all_counted(spark):
    n = B.SEARCH_ROWS + 300
    values = spark.range(n).select((F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(0).alias("fold"), F.array((F.col("id") % 2).cast("double")).alias("x"))
    data = B.binned(stored(values.withColumn("features", array_to_vector("x"))))
    assert data.rows.count() == n
    trees = B.fit_rows(data, B.Setting(n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0)).trees
    ids = np.arange(n)
    y, x = ids % 3 == 0, ids % 2
    w = (n - y.sum()) / y.sum()
    for side in (0, 1):
        p, q = (y & (x == side)).sum(), (~y & (x == side)).sum()
        assert trees.margin(np.array([[float(side)]]))[0] == pytest.approx((w * p - q) / 2 / ((w * p + q) / 4), rel=1e-9)


def test_scoring_trains_on_all_labelled_rows(spark, data, monkeypatch):
    seen = []
    fit = B.fit_rows
    monkeypatch.setattr(B, "fit_rows", lambda found, setting: seen.append(found.rows.count()) or fit(found, setting))
    for name in ("drawn", "sampled"):
        monkeypatch.setattr(B, name, lambda *a, **k: pytest.fail("a sample"))
    t = Marts(spark, data)
    modelling.trained_predictions(t)
    assert seen == [t.split_view.where("split in ('train', 'valid')").count()]


@pytest.mark.parametrize("s", [
    B.Setting(n_estimators=6, max_depth=3, learning_rate=0.3),
    B.Setting(n_estimators=4, max_depth=12, learning_rate=0.2, gamma=1.0, reg_alpha=0.3, reg_lambda=0.1, min_child_weight=3, weight_factor=2.0),
])
def test_trees_of_the_jvm_are_those_of_numpy(spark, s):
    x, y, fold = table(4000, 11)
    data = B.Binned.of(x, y, fold)
    got = B.fit(spark, data, s).trees
    trees, margin = B.boost(data, np.ones(len(y), dtype=bool), s)
    assert len(got.feature) == sum(len(t[0]) for t in trees)
    assert np.allclose(got.margin(x), margin, atol=1e-9)
    scores, _ = B.search(spark, data, [s], 3, refit=False)
    want = []
    for f in range(3):
        _, margin = B.boost(data, fold != f, s)
        said, there = margin[fold == f] > 0, y[fold == f] == 1
        want.append(2 * (said & there).sum() / (said.sum() + there.sum()))
    assert scores == [pytest.approx(np.mean(want))]


def test_drawn_rows_and_columns_of_the_jvm(spark):
    x, y, fold = table(4000, 12)
    data = B.Binned.of(x, y, fold)
    whole, drawn = (B.Setting(n_estimators=20, max_depth=4, learning_rate=0.2, subsample=p, colsample=q) for p, q in ((1.0, 1.0), (0.6, 0.6)))
    (all_of, some), _ = B.search(spark, data, [whole, drawn], 3, refit=False)
    assert some != all_of and abs(some - all_of) < 0.05
    one = B.fit(spark, data, B.Setting(n_estimators=30, max_depth=2, colsample=0.2)).trees
    assert set(one.feature.tolist()) == {-1, 0, 1, 3, 4}
    assert all(len({f for f in one.feature[a:b].tolist() if f >= 0}) <= 1 for a, b in zip(one.start, [*one.start[1:], len(one.feature)]))


def test_search_of_no_rows_or_one_class(spark):
    s = B.Setting(n_estimators=2, max_depth=2)
    none, one = B.Binned.of(np.zeros((0, 0)), np.zeros(0), np.zeros(0)), B.Binned.of(np.ones((4, 1)), np.ones(4), np.arange(4) % 2)
    assert B.search(spark, none, [s], 2)[0] == [0.0]
    assert B.search(spark, one, [s], 2)[0] == [0.0]


def test_a_search_takes_all_rows(spark, monkeypatch):
    n, seen = B.SEARCH_ROWS + 300, []
    values = spark.range(n).select((F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 2).cast("int").alias("fold"), F.array((F.col("id") % 7).cast("double")).alias("x"))
    training = stored(values.withColumn("features", array_to_vector("x")))
    search = B.search
    monkeypatch.setattr(B, "search", lambda spark, data, *rest: seen.append(len(data.label)) or search(spark, data, *rest))
    found = M.random_search(M.BOOSTED, training, M.ClassSizes(n - n // 3 - 1, n // 3 + 1), draws=2, folds=2, space={"n_estimators": [2, 3], "max_depth": [2]})
    assert seen == [n] and len(found.scores) == 2
