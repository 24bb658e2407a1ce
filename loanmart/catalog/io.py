"""Sources and sinks (IO): each query writes the whole table and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..operators import cleaning as C
from ..sources import raw, sinks, snapshots as Sn
from ..sources.publish import AuditFailed, Limits, publish
from .base import Marts, query, r


def _typed(columns: dict[str, str]) -> str:
    """Select list of typed columns in the shared output form."""
    form = {"double": lambda c: r(c), "date": lambda c: f"cast({c} as varchar)"}
    return ", ".join(f"{form.get(kind, str)(c)} as {c}" for c, kind in columns.items())


def _text(columns) -> str:
    """The same for columns written to CSV and read as text: an empty text comes back as NULL."""
    return ", ".join(f"nullif(cast({c} as varchar), '') as {c}" for c in columns)


@query("io1_csv_typed_scan", f"select {_typed(S.LEDGER)} from fx_lms")
def io1(t: Marts) -> DataFrame:
    path = t.scratch()
    sinks.write_csv(t.fx_lms.select(*S.LEDGER), path)
    return raw.read_csv_typed(t.spark, path, S.LEDGER)


def _losses(c: str, kind: str) -> list[str]:
    """Texts of a raw column without a value of its type, and fractions an integer drops."""
    number = f"try_cast({c} as double)"
    bad = f"try_cast({c} as date) is null" if kind == "date" else f"({number} is null or isnan({number}))"
    tests = {"unreadable": f"nullif({c}, '') is not null and {bad}"}
    if kind == "int":
        tests["truncated"] = f"{number} <> trunc({number})"
    return [f"select '{c}' as \"column\", '{reason}' as reason, count(*) as n from fx_fin where {test}" for reason, test in tests.items()]


@query(
    "io1_rescued_values",
    f"select * from ({' union all '.join(s for c, kind in S.FINANCIALS.items() if kind != 'string' for s in _losses(c, kind))}) where n > 0",
)
def io1_rescued(t: Marts) -> DataFrame:
    """What typing the raw financials would lose, by column and reason."""
    path = t.scratch()
    sinks.write_csv(t.fx_fin.select(*S.FINANCIALS), path)
    return raw.rescue_counts(raw.read_csv_rescued(t.spark, path, S.FINANCIALS))


@query("io2_csv_text_scan", f"select {_text(S.FINANCIALS)} from fx_fin")
def io2(t: Marts) -> DataFrame:
    path = t.scratch()
    sinks.write_csv(t.fx_fin.select(*S.FINANCIALS), path)
    return raw.read_csv_text(t.spark, path, S.FINANCIALS)


@query(
    "io3_snapshot_slices",
    "select cast(snapshot_date as varchar) as snapshot_date, count(*) as n, count(distinct customer_id) as customers from fx_att group by snapshot_date",
)
def io3(t: Marts) -> DataFrame:
    path = t.scratch()
    Sn.write_snapshots_csv(t.fx_att, path)
    stored = raw.read_csv_header(t.spark, path)
    return stored.groupBy(F.col("snapshot_date").cast("date").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers")
    )


_AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "io4_parquet_scan",
    f"""select * replace ({", ".join(f"{r(c)} as {c}" for c in _AMOUNTS)}, cast(cast(l_shipdate as date) as varchar) as l_shipdate) from lineitem""",
)
def io4(t: Marts) -> DataFrame:
    return t.lineitem.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query(
    "io5_parquet_overwrite",
    "select customer_id, age, occupation, cast(snapshot_date as varchar) as snapshot_date from c_att",
)
def io5(t: Marts) -> DataFrame:
    path = t.scratch()
    att = t.att
    Sn.write_snapshots(att, path)
    # one month is written again: the table must hold every month once
    Sn.write_snapshots(Sn.slice_month(att, "1998-03-01"), path)
    return Sn.read_snapshots(t.spark, path).select("customer_id", "age", "occupation", "snapshot_date")


@query(
    "io5_audited_publish",
    f"select {_typed(S.LEDGER)}, 1 as refused from (select distinct * from fx_lms)",
)
def io5_audited(t: Marts) -> DataFrame:
    """The ledger without copies is published; the ledger with NULL loans is then refused and changes nothing."""
    path, rows = t.scratch(), C.dedup(t.fx_lms.select(*S.LEDGER))
    limits = Limits(keys=("loan_id", "installment_num"), date="snapshot_date", least_rows=1)
    publish(rows, path, limits)
    published = t.spark.read.schema(rows.schema).parquet(path)
    try:
        publish(published.withColumn("loan_id", F.when(F.col("installment_num") > 1, F.col("loan_id"))), path, limits)
        refused = False
    except AuditFailed:
        refused = True
    return t.spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query(
    "io6_csv_sink",
    "select loan_id, customer_id, cast(loan_start_date as varchar) as loan_start_date, label, cast(snapshot_date as varchar) as snapshot_date from g_lbl",
)
def io6(t: Marts) -> DataFrame:
    path = t.scratch()
    sinks.write_csv(t.gold_labels, path)
    types = {"loan_id": "string", "customer_id": "string", "loan_start_date": "date", "label": "int"}
    types |= {"label_def": "string", "snapshot_date": "date"}
    return raw.read_csv_typed(t.spark, path, types).drop("label_def")


@query(
    "io7_prediction_outbox",
    """select form, customer_id, cast(loan_start_date as varchar) as loan_start_date, prediction from
 (select customer_id, loan_start_date, label as prediction from g_lbl), (values ('parquet'), ('csv')) f(form)""",
)
def io7(t: Marts) -> DataFrame:
    predictions = t.gold_labels.select("customer_id", "loan_start_date", F.col("label").alias("prediction"))
    parquet, csv = sinks.write_outbox(predictions, t.scratch(), "2000-06-01")
    types = {"customer_id": "string", "loan_start_date": "date", "prediction": "int"}
    return (
        t.spark.read.parquet(parquet)
        .select(F.lit("parquet").alias("form"), *types)
        .unionByName(raw.read_csv_typed(t.spark, csv, types).select(F.lit("csv").alias("form"), *types))
    )


@query(
    "io8_record_table",
    "select cast(snapshot_date as varchar) as run_date, count(*) as label_count, sum(label)::bigint as label_1 from g_lbl group by snapshot_date",
)
def io8(t: Marts) -> DataFrame:
    path, export = t.scratch(), t.scratch()
    records = t.gold_labels.groupBy(F.col("snapshot_date").alias("run_date")).agg(
        F.count(F.lit(1)).alias("label_count"), F.sum("label").alias("label_1")
    )
    sinks.write_records(records, path)
    # a run that is repeated replaces its record
    sinks.write_records(records.where("run_date = date '1998-06-01'"), path)
    sinks.export_records(t.spark, path, export, sep="|")
    types = {"label_count": "bigint", "label_1": "bigint", "run_date": "date"}
    return t.spark.read.option("header", True).option("sep", "|").schema(S.struct(types)).csv(export)


@query(
    "io9_view_with_label",
    f"""select loan_id, label, {r('repayment_ability')} as repayment_ability from g_merged""",
)
def io9(t: Marts) -> DataFrame:
    stored = t.stored(t.labelled)
    return raw.read_parquet(t.spark, stored.inputFiles()[0].rsplit("/", 1)[0]).select(
        "loan_id", "label", "repayment_ability"
    )


@query(
    "io10_view_registration",
    "select credit_mix, count(*) as n from c_fin group by credit_mix",
)
def io10(t: Marts) -> DataFrame:
    name = f"financials_{uuid.uuid4().hex}"
    raw.register_global_views({name: t.fin})
    return t.spark.sql(f"select credit_mix, count(*) as n from global_temp.{name} group by credit_mix")


@query(
    "io11_previous_months",
    """select customer_id, credit_mix, cast(snapshot_date as varchar) as snapshot_date from c_fin where snapshot_date <= date '1999-02-01'""",
)
def io11(t: Marts) -> DataFrame:
    path = t.scratch()
    Sn.write_snapshots(t.fin, path)
    return Sn.before(Sn.read_snapshots(t.spark, path), "1999-03-01").select(
        "customer_id", "credit_mix", "snapshot_date"
    )


@query(
    "clean_clickstream",
    "select distinct customer_id, cast(snapshot_date as varchar) as snapshot_date, "
    + ", ".join(f"cast(trunc(try_cast({c} as double)) as integer) as {c}" for c, kind in S.CLICKSTREAM.items() if kind == "int")
    + " from fx_cs",
)
def clean_clickstream(t: Marts) -> DataFrame:
    path = t.scratch()
    sinks.write_csv(t.fx_cs.select(*S.CLICKSTREAM), path)
    return C.dedup(C.clean_clickstream(raw.read_csv_text(t.spark, path, S.CLICKSTREAM)))
