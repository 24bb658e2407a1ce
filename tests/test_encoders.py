import pytest
from loanmart.operators import encoders as E
from pyspark.sql import functions as F

SPEC = E.EncoderSpec(
    caps=("income",), fills=("income", "age"), one_hot=("job",), ordinal=("mix",), scaled=("income",), sentinels={"mix": "Unknown"}
)


def train(spark):
    data = [(float(i), i % 3 if i % 5 else None, "A" if i % 2 else None, ["Good", "Bad", "Standard", "Unknown"][i % 4]) for i in range(101)]
    return spark.createDataFrame(data, "income double, age int, job string, mix string")


def test_fit_and_transform(spark):
    df = train(spark)
    fitted = E.fit_encoders(df, SPEC)
    assert fitted.caps == {"income": 97.0}
    assert fitted.fills == {"income": 50.0, "age": 1.0}
    assert fitted.one_hot == {"job": ["A", None]}
    assert fitted.ordinal == {"mix": ["Bad", "Good", "Standard", None]}
    mean, std = fitted.scalers["income"]
    assert mean == 50.0 and abs(std - (sum((i - 50) ** 2 for i in range(101)) / 101) ** 0.5) < 1e-9
    new = spark.createDataFrame(
        [(97.0, None, "A", "Bad"), (500.0, 2, "Z", "New"), (None, 2, None, None)],
        "income double, age int, job string, mix string",
    )
    got = fitted.transform(new).collect()
    at = lambda x: (x - mean) / std
    assert [round(r["income"], 9) for r in got] == [round(at(v), 9) for v in (97.0, 97.0, 50.0)]
    assert [r["age"] for r in got] == [1.0, 2.0, 2.0]
    assert [(r["job_A"], r["job_None"]) for r in got] == [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    assert [r["mix"] for r in got] == [0.0, -1.0, 3.0]


def test_null_category_not_seen(spark):
    df = train(spark).where("job is not null").where("mix <> 'Unknown'")
    fitted = E.fit_encoders(df, SPEC)
    row = fitted.transform(spark.createDataFrame([(1.0, 1, None, None)], "income double, age int, job string, mix string")).first()
    assert row["job_A"] == 0.0 and row["mix"] == -1.0


def test_constant_column_and_processed_scalers(spark):
    df = train(spark).withColumn("income", F.lit(3.0))
    fitted = E.fit_encoders(df, SPEC)
    assert fitted.scalers["income"][1] == 0.0
    assert fitted.transform(df).agg(F.max(F.abs("income"))).first()[0] == 0.0
    spec = E.EncoderSpec(**{**SPEC.__dict__, "fit_scalers_on": "processed"})
    capped = E.fit_encoders(train(spark), spec)
    assert capped.scalers["income"][0] < 50.0
    approx = E.EncoderSpec(**{**SPEC.__dict__, "quantiles": "approx"})
    assert abs(E.fit_encoders(train(spark), approx).caps["income"] - 97.0) <= 1


def test_parameter_table_round_trip(spark):
    fitted = E.fit_encoders(train(spark), SPEC)
    again = E.FittedEncoders.from_table(fitted.to_table(spark))
    assert again == fitted


def test_many_categories_go_to_one_sparse_vector(spark):
    df = spark.range(3_000).select(F.concat(F.lit("c"), F.col("id")).alias("wide"), (F.col("id") % 3).cast("double").alias("x"))
    spec = E.EncoderSpec(caps=(), fills=(), one_hot=(), ordinal=(), scaled=("x",), sentinels={}, hashed=("wide",))
    fitted = E.fit_encoders(df, spec)
    assert E.FittedEncoders.from_table(fitted.to_table(spark)) == fitted
    out = fitted.transform(df)
    assert set(out.columns) == {"x", E.HASHED_COLUMN}
    assert out.first()[E.HASHED_COLUMN].numNonzeros() == 1
    assert len(E.fit_categories(df, ["wide"])["wide"]) == 3_000
