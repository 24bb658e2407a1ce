from datetime import date

from loanmart.functions import numbers as N, text as X
from loanmart.operators import cleaning as C, features as Fe, quality as Q
from pyspark.sql import functions as F

from conftest import rows


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_to_null(spark):
    got = column(spark, ["23_", "_", "_______", "Media_Manager", None, ""], "string", X.strip_to_null)
    assert got == ["23", None, None, "MediaManager", None, None]


def test_patterns(spark):
    assert column(spark, ['""""Ann', '""Bo', None], "string", lambda c: X.remove_pattern(c, '"{3,}')) == [
        "Ann",
        '""Bo',
        None,
    ]
    pattern = r"^\d{3}-\d{2}-\d{4}$"
    values = ["123-45-6789", "123-45-678", "x123-45-6789", None]
    assert column(spark, values, "string", lambda c: X.keep_matching(c, pattern)) == [values[0], None, None, None]
    assert column(spark, ["123456789", "1234567890", None], "string", lambda c: X.null_if_shorter(c, 10)) == [
        None,
        "1234567890",
        None,
    ]


def test_numbers(spark):
    ages = ["0", "1", "150", "151", "-500", "abc", None]
    got = column(spark, ages, "string", lambda c: N.null_outside(N.to_type(c, "int"), 1, 150))
    assert got == [None, 1, 150, None, None, None, None]
    counts = ["-1", "0", "7.0", "3.9", "3.5_", "_", "99999999999"]
    got = column(spark, counts, "string", lambda c: N.null_if_negative(N.to_type(X.strip_to_null(c), "int")))
    assert got == [None, 0, 7, 3, 3, None, None]
    assert column(spark, [1.0, float("nan"), None], "double", N.nan_to_null) == [1.0, None, None]
    assert column(spark, [1.0, 5.0, 5.5, None], "double", lambda c: N.cap_at(c, 5.0)) == [1.0, 5.0, 5.0, None]


def test_duration(spark):
    values = ["22 Years and 1 Months", "1 Year and 0 Month", "0 Years and 0 Months", "NA", None]
    got = column(spark, values, "string", X.duration_years)
    assert [None if g is None else round(g, 9) for g in got] == [round(22 + 1 / 12, 9), 1.0, 0.0, 0.0, None]


def test_clean_attributes_and_dedup(spark):
    raw = spark.createDataFrame(
        [
            ("C1", '""""Ann_', "23_", "123-45-6789", "Media_Manager", "2024-01-01"),
            ("C1", '""""Ann_', "23_", "123-45-6789", "Media_Manager", "2024-01-01"),
            ("C2", "_", "8698_", "#F%$D@*&8", "_______", "2024-01-01"),
            ("C3", None, None, None, None, "not a date"),
        ],
        "Customer_ID string, Name string, Age string, SSN string, Occupation string, snapshot_date string",
    )
    got = rows(C.dedup(C.clean_attributes(raw)))
    assert got == [
        ("C1", "Ann", 23, "123-45-6789", "MediaManager", date(2024, 1, 1)),
        ("C2", None, None, "Unknown", "Unknown", date(2024, 1, 1)),
        ("C3", None, None, "Unknown", "Unknown", None),
    ]


def test_clean_financials(spark):
    raw = spark.createDataFrame(
        [("C1", "100.5_", "-1", "-2.5", "", "_", "!@9#%8", "2024-02-01")],
        "customer_id string, annual_income string, num_of_loan string, changed_credit_limit string, "
        "type_of_loan string, credit_mix string, payment_behaviour string, snapshot_date string",
    )
    got = C.clean_financials(raw).first().asDict()
    assert got["annual_income"] == 100.5
    assert got["num_of_loan"] is None
    assert got["changed_credit_limit"] == -2.5
    assert (got["type_of_loan"], got["credit_mix"], got["payment_behaviour"]) == ("Unknown",) * 3


def test_loan_flags_and_vocabulary(spark):
    values = [None, "Not Specified", "Auto Loan, Student Loan, and Payday Loan", "Auto Loan and Payday Loan"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, type_of_loan string")
    flags = Fe.loan_type_flags(df).orderBy("i").collect()
    assert [r["type_of_loan_auto_loan"] for r in flags] == [0, 0, 1, 1]
    assert [r["type_of_loan_credit-builder_loan"] for r in flags] == [0, 0, 0, 0]
    assert rows(Fe.loan_vocabulary(df)) == [("Auto Loan",), ("Payday Loan",), ("Student Loan",)]


def test_audits(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, v string")
    assert rows(Q.null_audit(df)) == [("k", 0, 3), ("v", 2, 3)]
    assert Q.duplicate_audit(df).first().asDict() == {"rows": 3, "distinct_rows": 2, "duplicates": 1}
    empty = df.limit(0)
    assert Q.duplicate_audit(empty).first().asDict() == {"rows": 0, "distinct_rows": 0, "duplicates": 0}
    dates = spark.sql("select date '2024-01-01' as snapshot_date union all select date '2024-01-02'")
    assert rows(Q.calendar_audit({"t": dates})) == [("t", 2, 1)]
    profile = Q.profile(spark.range(5).withColumnRenamed("id", "x"), ["x"]).first()
    assert (profile["n"], profile["mean"], profile["q25"], profile["q50"], profile["max"]) == (5, 2.0, 1.0, 2.0, 4.0)
