"""Registration of queries and the SQL text of their checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas as S, scratch
from ..fixtures import BASE_TABLES, FIXTURES, Tables
from ..operators import cleaning as C, features as Fe, joins as J, labels as L, ledger as Lg, splits as Sp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
OOT_DATE = "2000-06-01"
SPLIT_KEYS = ("loan_id", "customer_id", "loan_start_date")


class Marts(Tables):
    """The fixtures plus the marts built from them by the library."""

    @cached_property
    def att(self) -> DataFrame:
        return C.dedup(C.clean_attributes(self.fx_att))

    @cached_property
    def fin(self) -> DataFrame:
        return C.dedup(C.clean_financials(self.fx_fin))

    @cached_property
    def ledger(self) -> DataFrame:
        return Lg.with_days_past_due(C.dedup(self.fx_lms))

    @cached_property
    def gold_labels(self) -> DataFrame:
        return L.default_labels(self.ledger)

    @cached_property
    def features(self) -> DataFrame:
        return Fe.build_features(self.att, self.fin)

    @cached_property
    def labelled(self) -> DataFrame:
        return J.labelled_features(self.features, self.gold_labels)

    @cached_property
    def split_view(self) -> DataFrame:
        """Labelled rows with their split; the joined rows are written once, the split is a projection."""
        return self.split_of(*self.labelled.columns)

    def split_of(self, *columns: str) -> DataFrame:
        """The same with only the columns named, and what the split needs, written."""
        needed = dict.fromkeys((*SPLIT_KEYS, "label", "label_snapshot_date", *columns))
        return with_split(self, self.labelled.select(*needed))

    def stored(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write a frame that several jobs read; lost executors then cost no rework."""
        with scratch.compiled_methods(self.spark):
            return scratch.stored(df, name)

    def scratch(self) -> str:
        return scratch.new_path(self.spark, "files")


def with_split(t: Marts, labelled: DataFrame) -> DataFrame:
    """Labelled rows, written once with the hash their splits are cut by."""
    rows = t.stored(Sp.with_row_hash(labelled, SPLIT_KEYS))
    return Sp.assign_splits(rows, OOT_DATE, SPLIT_KEYS, hashed=Sp.ROW_HASH).drop(Sp.ROW_HASH)


def present(df: DataFrame) -> DataFrame:
    """Output form shared with the checks: dates as text, doubles rounded, flags as 0/1."""

    def column(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.round(c, DIGITS).alias(field.name)
        if isinstance(field.dataType, T.BooleanType):
            return c.cast("int").alias(field.name)
        return c.alias(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


def query(key: str, oracle: str | None = None):
    """Register ``fn(marts) -> DataFrame`` under an inventory key."""

    def wrap(fn):
        if key in QUERIES:
            raise KeyError(f"{key} registered twice")
        QUERIES[key] = lambda spark, folder: present(fn(Marts(spark, folder)))
        if oracle is not None:
            ORACLES[key] = with_tables(oracle)
        return fn

    return wrap


def r(expr: str) -> str:
    return f"(round({expr}, {DIGITS}) + 0.0e0)"  # no negative zero


# --- SQL of the derived tables used by the checks ---------------------------------
def _strip(c: str) -> str:
    return f"nullif(replace({c}, '_', ''), '')"


def _number(c: str) -> str:
    return f"try_cast({c} as double)"


def _integer(c: str) -> str:
    return f"cast(trunc(try_cast({c} as double)) as integer)"


def _financial(c: str, kind: str) -> str:
    text = _strip(c) if c in S.FINANCIAL_UNDERSCORE_COLUMNS else f"nullif({c}, '')"
    if c == "payment_behaviour":
        text = f"case when length({c}) >= 10 then {c} end"
    if kind == "double":
        return _number(text)
    if kind == "int":
        value = _integer(text)
        if c in S.FINANCIAL_NONNEGATIVE_COLUMNS:
            value = f"case when {value} >= 0 then {value} end"
        return value
    return f"coalesce({text}, 'Unknown')" if c in S.FINANCIAL_UNKNOWN_COLUMNS else text


_FIN = ", ".join(
    c if kind == "date" else f"{_financial(c, kind)} as {c}" for c, kind in S.FINANCIALS.items()
)
_AGE = _integer(_strip("age"))
_FLAGS = ", ".join(
    f"case when contains(type_of_loan, '{kind}') then 1 else 0 end as \"type_of_loan_{kind.lower().replace(' ', '_')}\""
    for kind in S.LOAN_TYPES
)
FLAG_NAMES = [f"type_of_loan_{kind.lower().replace(' ', '_')}" for kind in S.LOAN_TYPES]
DURATION_SQL = (
    "case when credit_history_age is null then null"
    " when regexp_matches(credit_history_age, '^\\d+\\s+Years?\\s+and\\s+\\d+\\s+Months?')"
    " then cast(regexp_extract(credit_history_age, '^(\\d+)\\s+Years?\\s+and\\s+(\\d+)\\s+Months?', 1) as double)"
    " + cast(regexp_extract(credit_history_age, '^(\\d+)\\s+Years?\\s+and\\s+(\\d+)\\s+Months?', 2) as double) / 12.0e0"
    " else 0.0e0 end"
)
FEATURE_COLUMNS = [
    "customer_id",
    "snapshot_date",
    "age",
    "occupation",
    *[c for c in S.FINANCIALS if c not in ("customer_id", "snapshot_date", "type_of_loan")],
    *FLAG_NAMES,
    "investment_income_ratio",
    "income_per_card",
    "repayment_ability",
]

DERIVED: dict[str, str] = {
    "c_att": f"""
select distinct customer_id,
 regexp_replace({_strip("name")}, '"{{3,}}', '', 'g') as name,
 case when {_AGE} between 1 and 150 then {_AGE} end as age,
 coalesce(case when regexp_matches(ssn, '^\\d{{3}}-\\d{{2}}-\\d{{4}}$') then ssn end, 'Unknown') as ssn,
 coalesce({_strip("occupation")}, 'Unknown') as occupation,
 snapshot_date
from fx_att""",
    "c_fin": f"select distinct {_FIN} from fx_fin",
    "c_lms_zero": """
select loan_id, customer_id, loan_start_date, coalesce(tenure, 0) as tenure,
 coalesce(installment_num, 0) as installment_num, coalesce(loan_amt, 0) as loan_amt, coalesce(due_amt, 0) as due_amt,
 coalesce(paid_amt, 0) as paid_amt, coalesce(overdue_amt, 0) as overdue_amt, coalesce(balance, 0) as balance, snapshot_date,
 coalesce(cast(installment_num as integer), 0) as mob,
 coalesce(case when due_amt = 0 then 0 else cast(ceil(overdue_amt / due_amt) as integer) end, 0) as installments_missed
from (select distinct * from fx_lms)""",
    "c_lms": """
select *, case when overdue_amt > 0 then date_diff('day', first_missed_date, snapshot_date) else 0 end as dpd
from (select *, case when installments_missed > 0
  then cast(snapshot_date - to_months(installments_missed) as date) end as first_missed_date from c_lms_zero)""",
    "g_lbl": """
select loan_id, customer_id, loan_start_date, case when dpd >= 30 then 1 else 0 end as label,
 '30dpd_6mob' as label_def, snapshot_date from c_lms where mob = 6""",
    "g_join": "select * from c_att full outer join c_fin using (customer_id, snapshot_date)",
    "g_feat": f"""
select customer_id, snapshot_date, age, occupation,
 {", ".join((DURATION_SQL + " as credit_history_age") if c == "credit_history_age" else c
            for c in S.FINANCIALS if c not in ("customer_id", "snapshot_date", "type_of_loan"))},
 {_FLAGS},
 case when monthly_inhand_salary = 0 then 1.0e0 else amount_invested_monthly / monthly_inhand_salary end as investment_income_ratio,
 case when num_credit_card = 0 then monthly_inhand_salary else monthly_inhand_salary / num_credit_card end as income_per_card,
 monthly_inhand_salary - total_emi_per_month as repayment_ability
from g_join""",
    "g_merged": """
select f.*, f.snapshot_date as loan_start_date, f.snapshot_date as feature_snapshot_date,
 l.loan_id, l.label, l.label_def, l.snapshot_date as label_snapshot_date
from g_feat f join g_lbl l on f.customer_id = l.customer_id and f.snapshot_date = l.loan_start_date""",
    # stratified split of the labels known before the run month; the run month is out of time
    "g_hash": """
select *, substr(md5(concat_ws('|', loan_id, customer_id, cast(loan_start_date as varchar), '42')), 1, 13) as h
from g_merged where label_snapshot_date < date '2000-06-01'""",
    "g_rank": """
select *, rank() over (partition by label order by h) as rk, count(*) over (partition by label) as n from g_hash""",
    "g_split": """
select *, case when rk <= ceil(0.1e0 * n) then 'test'
 when rk <= ceil(0.1e0 * n) + ceil(0.2e0 * (n - ceil(0.1e0 * n))) then 'valid' else 'train' end as split
from g_rank""",
    "g_train": "select * from g_split where split = 'train'",
    "g_view": """
select * exclude (h, rk, n) from g_split
union all by name
select *, 'oot' as split from g_merged where label_snapshot_date = date '2000-06-01'""",
}
_CTES = {
    **{k: v.format(**{n: n for n in (*BASE_TABLES, *FIXTURES)}) for k, v in FIXTURES.items()},
    **DERIVED,
}


def with_tables(sql: str) -> str:
    """Prefix the WITH clauses a check needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(_CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({_CTES[n].strip()})" for n in needed)
    body = sql.strip()
    joined = f"with {ctes}"
    if body.lower().startswith("with "):
        return f"{joined},\n{body[5:]}"
    return f"{joined}\n{body}"
