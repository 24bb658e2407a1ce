"""Loan-style tables derived from the generic star-schema tables.

The SQL is plain enough for Spark and for a reference SQL engine, so one text
defines the input of a query and of its check.  Table names stand in braces.
Every row of the source tables takes part; where ``ok`` is divided without rest
a value is made dirty or a row is moved to the next month (so that outer joins
have rows without partner).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_CLICKS = ",\n ".join(
    f"cast((count(*) * {i} + max(event_id)) % {40 + i} as string) as fe_{i}" for i in range(1, 21)
)

FIXTURES: dict[str, str] = {
    # one row per customer and order month
    "fx_grain": """
select o_custkey as k, cast(date_trunc('month', o_orderdate) as date) as snapshot_date,
 max(o_orderkey) as ok, cast(max(o_totalprice) as decimal(18,2)) as mx, count(*) as n
from {orders}
group by o_custkey, cast(date_trunc('month', o_orderdate) as date)""",
    "fx_att": """
select concat('CUS_', c_custkey) as customer_id,
 concat(case when c_custkey % 31 = 0 then '\"\"\"\"' else '' end, c_name, case when c_custkey % 5 = 0 then '_' else '' end) as name,
 case when c_custkey % 97 = 0 then '-500' when c_custkey % 89 = 0 then '8698_' when c_custkey % 83 = 0 then 'unknown'
  else concat(18 + c_custkey % 60, case when c_custkey % 7 = 0 then '_' else '' end) end as age,
 case when c_custkey % 11 = 0 then '#F%$D@*&8'
  else concat(lpad(cast(c_custkey % 1000 as string),3,'0'),'-',lpad(cast(c_custkey % 100 as string),2,'0'),'-',lpad(cast(c_custkey % 10000 as string),4,'0')) end as ssn,
 case when c_custkey % 13 = 0 then '_______' else c_mktsegment end as occupation,
 case when ok % 41 = 0 then cast(snapshot_date + interval '1' month as date) else snapshot_date end as snapshot_date
from {customer} join {fx_grain} on k = c_custkey""",
    "fx_fin": """
select concat('CUS_', k) as customer_id,
 case when ok % 17 = 0 then concat(cast(mx as string),'_') when ok % 29 = 0 then '' else cast(mx as string) end as annual_income,
 case when ok % 31 = 0 then '0' when ok % 23 = 0 then null else concat(cast(floor(mx / 12) as bigint), '.', 10 + ok % 90) end as monthly_inhand_salary,
 case when ok % 53 = 0 then '-1' else concat(ok % 11, case when ok % 12 = 0 then '_' else '' end) end as num_bank_accounts,
 case when ok % 37 = 0 then '-1' else cast(ok % 9 as string) end as num_credit_card,
 cast(1 + ok % 34 as string) as interest_rate,
 case when ok % 59 = 0 then '-100' else cast(ok % 7 as string) end as num_of_loan,
 case when ok % 19 = 0 then '' when ok % 3 = 0 then 'Auto Loan, Student Loan, and Payday Loan' when ok % 3 = 1 then 'Not Specified' else 'Home Equity Loan, and Auto Loan' end as type_of_loan,
 cast((ok % 68) - 5 as string) as delay_from_due_date,
 case when ok % 61 = 0 then null when ok % 8 = 0 then concat(ok % 28, '_') else concat(ok % 28, '.7') end as num_of_delayed_payment,
 case when ok % 71 = 0 then '_' else concat((ok % 30) - 6, '.', lpad(cast(ok % 100 as string),2,'0')) end as changed_credit_limit,
 case when ok % 73 = 0 then null else cast(ok % 18 as string) end as num_credit_inquiries,
 case ok % 4 when 0 then '_' when 1 then 'Good' when 2 then 'Standard' else 'Bad' end as credit_mix,
 concat(cast(cast(mx - (ok % 900) as decimal(18,2)) as string), case when ok % 14 = 0 then '_' else '' end) as outstanding_debt,
 concat(20 + ok % 30, '.', ok % 97) as credit_utilization_ratio,
 case when ok % 43 = 0 then 'NA' else concat(ok % 30, ' Years and ', ok % 12, ' Months') end as credit_history_age,
 case ok % 3 when 0 then 'Yes' when 1 then 'No' else 'NM' end as payment_of_min_amount,
 cast(ok % 500 as string) as total_emi_per_month,
 cast(ok % 800 as string) as amount_invested_monthly,
 case when ok % 7 = 0 then '!@9#%8' else concat(case when ok % 2 = 0 then 'High' else 'Low' end, '_spent_Small_value_payments') end as payment_behaviour,
 cast(cast(mx * 2 - (ok % 1000) as decimal(18,2)) as string) as monthly_balance,
 case when ok % 47 = 0 then cast(snapshot_date + interval '1' month as date) else snapshot_date end as snapshot_date
from {fx_grain}""",
    # loan ledger, typed; a loan is an order, an installment one of its lines
    "fx_lms": """
select concat(concat('CUS_', o_custkey), '_', o_orderkey) as loan_id, concat('CUS_', o_custkey) as customer_id,
 cast(date_trunc('month', o_orderdate) as date) as loan_start_date, 10 as tenure, l_linenumber as installment_num,
 o_totalprice as loan_amt,
 case when l_linestatus = 'O' and l_quantity < 3 then 0.0e0 else l_extendedprice end as due_amt,
 case when l_orderkey % 67 = 0 then null else l_extendedprice * l_discount end as paid_amt,
 case when l_returnflag = 'R' then l_extendedprice * l_tax * 40 else 0.0e0 end as overdue_amt,
 case when l_orderkey % 79 = 0 then null else o_totalprice - l_extendedprice end as balance,
 cast(date_trunc('month', l_shipdate) as date) as snapshot_date
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "fx_cs": f"""
select {_CLICKS},
 concat('CUS_', user_id) as customer_id, cast(date_trunc('month', ts) as date) as snapshot_date
from {{events}}
group by user_id, cast(date_trunc('month', ts) as date)""",
    # a (label, prediction) pair per document with its source as the group
    "fx_pairs": """
select d.doc_id, d.source, l.quality as label, l.toxic as prediction
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
}


class Tables:
    """Frames of one data folder: ``t.orders`` reads Parquet, ``t.fx_att`` derives."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        # called for names not yet set: each frame is built once per instance
        if name in BASE_TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in FIXTURES:
            text = FIXTURES[name]
            inputs = [n for n in (*BASE_TABLES, *FIXTURES) if "{" + n + "}" in text]
            df = self.spark.sql(text, **{n: getattr(self, n) for n in inputs})
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df
