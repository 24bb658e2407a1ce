from datetime import date

from loanmart.operators import labels as L, ledger as Lg

SCHEMA = (
    "loan_id string, customer_id string, loan_start_date date, tenure int, installment_num int, "
    "loan_amt double, due_amt double, paid_amt double, overdue_amt double, balance double, snapshot_date date"
)


def build(spark, cases):
    data = [
        (f"L{i}", "C", date(2023, 1, 1), 10, 6, 100.0, due, None, overdue, None, snap)
        for i, (due, overdue, snap) in enumerate(cases)
    ]
    return Lg.with_days_past_due(spark.createDataFrame(data, SCHEMA)).orderBy("loan_id")


def test_days_past_due_edges(spark):
    cases = [
        (0.0, 0.0, date(2024, 1, 1)),
        (0.0, 5.0, date(2024, 1, 1)),
        (None, None, date(2024, 1, 1)),
        (100.0, 200.0, date(2024, 3, 1)),
        (100.0, 200.1, date(2024, 3, 1)),
        (100.0, 50.0, date(2024, 3, 31)),
        (100.0, 50.0, date(2023, 3, 1)),
    ]
    got = build(spark, cases).collect()
    assert [r["installments_missed"] for r in got] == [0, 0, 0, 2, 3, 1, 1]
    assert [r["first_missed_date"] for r in got] == [
        None,
        None,
        None,
        date(2024, 1, 1),
        date(2023, 12, 1),
        date(2024, 2, 29),
        date(2023, 2, 1),
    ]
    assert [r["dpd"] for r in got] == [0, None, 0, 60, 91, 31, 28]
    # numeric NULLs of the whole row are filled, dates stay
    assert got[2]["paid_amt"] == 0 and got[2]["due_amt"] == 0 and got[2]["balance"] == 0


def test_labels(spark):
    cases = [(0.0, 5.0, date(2024, 1, 1)), (100.0, 50.0, date(2024, 3, 31)), (100.0, 50.0, date(2023, 3, 1))]
    labels = L.default_labels(build(spark, cases)).orderBy("loan_id").collect()
    assert [r["label"] for r in labels] == [0, 1, 0]
    assert {r["label_def"] for r in labels} == {"30dpd_6mob"}
    assert L.default_labels(build(spark, cases), mob=5).count() == 0
    assert L.label_definition(60, 3) == "60dpd_3mob"
