"""Steps several queries share are taken once."""

from datetime import date
from types import SimpleNamespace

import pytest
from loanmart import schemas as S, scratch
from loanmart.catalog import io as Io, modelling as Ml, monitoring as Mo
from loanmart.operators import drift as D, order_stats as O
from pyspark.sql import functions as F

from conftest import rows


def tables(spark, folder, **frames):
    """Frames in place of a data folder; ``written`` names what was stored."""
    written = []

    def stored(df, name="table"):
        written.append(name)
        return scratch.stored(df, name)

    return SimpleNamespace(spark=spark, scratch=lambda: f"{folder}/files", stored=stored, written=written, **frames)


def test_the_refused_ledger_is_made_from_the_published_one(spark, folder, monkeypatch):
    values = {"string": "a", "int": 1, "double": 2.0, "date": date(2000, 1, 1)}
    one = {c: values[kind] for c, kind in S.LEDGER.items()}
    ledger = [tuple({**one, "loan_id": loan, "installment_num": k}.values()) for loan in "ab" for k in (1, 2, 2)]
    t, seen, publish = tables(spark, folder, fx_lms=spark.createDataFrame(ledger, S.struct(S.LEDGER))), [], Io.publish

    def watched(df, path, audit=None):
        seen.append(df.inputFiles())
        publish(df, path, audit)

    monkeypatch.setattr(Io, "publish", watched)
    got = rows(Io.io5_audited(t), "loan_id", "installment_num", "refused")
    assert got == [("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, True)]
    assert len(seen) == 2 and seen[1] and all(f"{folder}/files/" in f for f in seen[1])


def test_bins_of_months_are_counted_once(spark, folder):
    made = [(date(1997 + k % 3, 1 + k % 2, 5), float(k), k % 7 + 0.0, 0.1, 0.2, k % 4) for k in range(120)]
    lines = spark.createDataFrame(made, "l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_linenumber int")
    t = tables(spark, folder, lineitem=lines)
    psi = Mo.monthly_psi(t)
    assert t.written == ["psi"] and psi.inputFiles()
    assert psi.select("date").distinct().count() == 4 and psi.count() == 20


def test_counts_of_bins_with_nulls_and_nans(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", 9.0), ("b", None), ("b", -1.0), ("c", None)], "k string, x double")
    got = {r["k"]: (r["n"], list(r["counts"])) for r in D.bin_counts(df, {"x": [0.0, 1.0, 1.0, 2.0]}, ("k",)).collect()}
    assert got == {"a": (4, [1, 0, 2]), "b": (1, [0, 0, 0]), "c": (0, [0, 0, 0])}


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_values_at_the_bounds_are_in_no_interval(spark, kind):
    open_ = [O._Interval("x", None, 2, 0, 2, [0]), O._Interval("x", 4, 7, 3, 2, [3])]
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 7, 8, None)], "x int").select(F.col("x").cast(kind).alias("x"))
    got = [r[0] for r in df.select(O._interval_of(F.col("x"), open_, [0, 1], kind)).collect()]
    assert got == [0, None, None, None, 1, None, None, None]


def test_labels_are_made_once_for_fit_and_scoring(spark, folder):
    made = [(f"C{k}", date(1999, 1, 1), float(k), float(k % 5), float(k % 3)) for k in range(60)]
    features = spark.createDataFrame(made, "customer_id string, snapshot_date date, total_emi_per_month double, outstanding_debt double, credit_history_age double")
    labels = [(f"L{k}", f"C{k}", date(1999, 1, 1), k % 2, "d", date(1999, 7, 1)) for k in range(40)]
    gold = spark.createDataFrame(labels, "loan_id string, customer_id string, loan_start_date date, label int, label_def string, snapshot_date date")
    t = tables(spark, folder, features=features, gold_labels=gold)
    assert {c for c, in rows(Ml.predictions(t), "customer_id")} == {f"C{k}" for k in range(40, 60)}
    assert t.written.count("labels") == 1
