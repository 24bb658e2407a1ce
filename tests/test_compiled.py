import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loanmart.operators import boosting, models as M, scoring as Sc
from loanmart.operators.compiled import compile_model

FEATURES = ["x-1", 'a "b"', "n", "flag"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        x, y, n, flag = float(rng.normal()), float(rng.integers(0, 40)) / 8, int(rng.integers(0, 9)), float(rng.integers(0, 2))
        label = int(x + 0.4 * y - 0.2 * n + flag > 0.5) if i % 17 else int(rng.integers(0, 2))
        rows.append((i, x, y, n, flag, label, "other", "split here"))
    return spark.createDataFrame(rows, 'id long, `x-1` double, `a "b"` double, n int, flag double, label int, prediction string, `select` string')


@pytest.fixture(scope="module")
def fits(frame):
    training, sizes = M.prepare_training(frame, FEATURES, ["id"], folds=1)
    some = {M.LOGISTIC: {"C": 1.0, "penalty": "l1"}, M.SVM: {"max_iter": 30}, M.BOOSTED: {"n_estimators": 6, "max_depth": 4}}
    out = {kind: M.fit_model(kind, training, sizes, **settings) for kind, settings in some.items()}
    setting = boosting.Setting(n_estimators=25, max_depth=5, reg_alpha=0.1)
    out["histograms"] = boosting.fit(frame.sparkSession, boosting.sampled(training), setting)
    return out


@pytest.mark.parametrize("kind", [M.LOGISTIC, M.SVM, M.BOOSTED, "histograms"])
def test_every_row_as_the_model_itself(frame, fits, kind):
    model = fits[kind]
    plain = frame.select("id", *[F.col(f"`{c}`") for c in FEATURES])
    want = {r["id"]: int(r["prediction"]) for r in model.transform(M.assemble(plain, FEATURES)).collect()}
    assert 0 < sum(want.values()) < len(want)
    scored = Sc.score(model, frame, FEATURES, keep=("id",))
    assert {r["id"]: r["prediction"] for r in scored.collect()} == want
    # the same text in another engine
    con = duckdb.connect()
    con.register("t", plain.toPandas())
    text = compile_model(model, FEATURES).prediction_sql('"')
    assert dict(con.sql(f"select id, {text} from t").fetchall()) == want


@pytest.mark.parametrize("kind", [M.LOGISTIC, "histograms"])
def test_missing_values_and_empty_frames(frame, fits, kind):
    model = fits[kind]
    assert set(compile_model(model, FEATURES).reads) <= set(FEATURES)
    first = compile_model(model, FEATURES).reads[0]
    holed = frame.limit(3).withColumn(first, F.lit(None).cast("double"))
    assert [r["prediction"] for r in Sc.score(model, holed, FEATURES, keep=("id",)).collect()] == [None] * 3
    assert Sc.score(model, frame.where("id < 0"), FEATURES, keep=("id",)).count() == 0
    twice = Sc.score(model, frame.unionByName(frame), FEATURES, keep=("id",))
    assert twice.count() == 2 * frame.count() and twice.distinct().count() == frame.count()


def test_a_projection_of_the_columns_read(frame, fits, folder):
    frame.select("id", *[F.col(f"`{c}`") for c in FEATURES], "label").write.parquet(f"{folder}/t")
    table = frame.sparkSession.read.parquet(f"{folder}/t")
    for model in fits.values():
        plan = Sc.score(model, table, FEATURES, keep=("id",))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "UDF" not in plan
        assert "label" not in plan


def test_large_ensembles_are_left_to_their_node_table(frame, fits):
    model = fits["histograms"]
    assert compile_model(model, FEATURES, most_nodes=10) is None
    assert compile_model(object(), FEATURES) is None


def test_a_tree_of_one_leaf(spark):
    leaf = boosting.BoostedModel(boosting.Trees(np.array([0]), np.array([-1]), np.zeros(1), np.zeros(1, int), np.array([-0.5])))
    assert [r["prediction"] for r in Sc.score(leaf, spark.range(2), FEATURES, keep=("id",)).collect()] == [0, 0]
