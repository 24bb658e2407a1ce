"""Splits (SP) and fitted encoders (EN), on the labelled feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..operators import encoders as E, joins as J, splits as Sp
from .aggregates import params
from .base import FLAG_NAMES, Marts, OOT_DATE, SPLIT_KEYS, query, r, with_split

_ID = ("loan_id", "customer_id", "loan_start_date")
_ID_SQL = "loan_id, customer_id, cast(loan_start_date as varchar) as loan_start_date"
SPEC = E.EncoderSpec()


@query("sp1_stratified_split", f"select {_ID_SQL}, label, split from g_split")
def sp1(t: Marts) -> DataFrame:
    rows = Sp.development_rows(t.stored(t.labelled.select(*_ID, "label", "label_snapshot_date")), OOT_DATE)
    plan = Sp.fit_split(rows, SPLIT_KEYS)
    return rows.select(*_ID, "label", plan.column().alias("split"))


@query(
    "sp2_out_of_time_split",
    """select split, label, count(*) as n, count(distinct loan_id) as loans from g_view group by split, label""",
)
def sp2(t: Marts) -> DataFrame:
    rows = t.stored(t.labelled.select(*_ID, "label", "label_snapshot_date"))
    return (
        Sp.assign_splits(rows, OOT_DATE, SPLIT_KEYS)
        .groupBy("split", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("loan_id").alias("loans"))
    )


# --- SQL pieces of the fitted parameters ------------------------------------------------
_FITTED = ", ".join(
    [f"quantile_cont(cast({c} as double), 0.97) as cap_{c}" for c in SPEC.caps]
    + [f"median(cast({c} as double)) as med_{c}" for c in SPEC.fills]
    + [f"avg({c}) as avg_{c}, stddev_pop({c}) as std_{c}" for c in SPEC.scaled]
)
_P = f"p as (select {_FITTED} from g_train)"


def _capped(c: str) -> str:
    x = f"cast({c} as double)"
    return f"case when {x} > cap_{c} then cap_{c} else {x} end" if c in SPEC.caps else x


def _filled(c: str) -> str:
    return f"coalesce({_capped(c)}, med_{c})"


def _scaled(c: str) -> str:
    return f"({_filled(c)} - avg_{c}) / std_{c}" if c in SPEC.scaled else _filled(c)


# categories the fixtures hold, in sorted order; None is the NULL category
_CATEGORIES = {
    "occupation": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Unknown", None],
    "payment_of_min_amount": ["No", "Yes", None],
    "payment_behaviour": ["High_spent_Small_value_payments", "Low_spent_Small_value_payments", "Unknown", None],
}


def _indicator(c: str, v: str | None) -> str:
    source = f"nullif({c}, 'NM')" if c == "payment_of_min_amount" else c
    test = f"{source} is null" if v is None else f"coalesce({source} = '{v}', false)"
    return f"cast({test} as double) as \"{c}_{v}\""


_ONE_HOT = ", ".join(_indicator(c, v) for c, values in _CATEGORIES.items() for v in values)
_ORDINAL = """case nullif(credit_mix, 'Unknown') when 'Bad' then 0.0e0 when 'Good' then 1.0e0 when 'Standard' then 2.0e0
 else (case when credit_mix is null or credit_mix = 'Unknown' then 3.0e0 else -1.0e0 end) end as credit_mix"""


@query("en1_fit_caps", " union all ".join(
    f"select '{c}' as \"column\", {r(f'quantile_cont(cast({c} as double), 0.97)')} as cap from g_train" for c in SPEC.caps
))
def en1(t: Marts) -> DataFrame:
    train = t.split_view.where("split = 'train'")
    caps, _ = E.fit_quantiles(train, E.EncoderSpec(fills=()))
    return params(t, list(caps.items()), "column string, cap double")


@query(
    "en2_apply_caps",
    f"with {_P} select {_ID_SQL}, split, {', '.join(f'{r(_capped(c))} as {c}' for c in SPEC.caps)} from g_view, p",
)
def en2(t: Marts) -> DataFrame:
    view = t.split_view
    caps, _ = E.fit_quantiles(view.where("split = 'train'"), E.EncoderSpec(fills=()))
    capped = E.cap_outliers(view, caps)
    return capped.select(*_ID, "split", *[F.col(c).cast("double").alias(c) for c in SPEC.caps])


@query("en3_fit_medians", " union all ".join(
    f"select '{c}' as \"column\", {r(f'median(cast({c} as double))')} as median from g_train" for c in SPEC.fills
))
def en3(t: Marts) -> DataFrame:
    train = t.split_of(*SPEC.fills).where("split = 'train'")
    _, medians = E.fit_quantiles(train, E.EncoderSpec(caps=()))
    return params(t, list(medians.items()), "column string, median double")


@query(
    "en4_apply_fills",
    f"with {_P} select {_ID_SQL}, split, {', '.join(f'{r(_filled(c))} as {c}' for c in SPEC.fills)} from g_view, p",
)
def en4(t: Marts) -> DataFrame:
    view = t.split_view
    caps, fills = E.fit_quantiles(view.where("split = 'train'"), SPEC)
    filled = E.fill_nulls(E.cap_outliers(view, caps), fills)
    return filled.select(*_ID, "split", *[F.col(c).cast("double").alias(c) for c in SPEC.fills])


@query("en5_one_hot", f"select {_ID_SQL}, split, {_ONE_HOT} from g_view")
def en5(t: Marts) -> DataFrame:
    view = E.null_sentinels(t.split_of(*SPEC.one_hot).select(*_ID, "split", *SPEC.one_hot), SPEC.sentinels)
    return E.one_hot(view, E.fit_categories(view.where("split = 'train'"), SPEC.one_hot))


@query("en6_ordinal", f"select {_ID_SQL}, split, {_ORDINAL} from g_view")
def en6(t: Marts) -> DataFrame:
    view = E.null_sentinels(t.split_of(*SPEC.ordinal).select(*_ID, "split", *SPEC.ordinal), SPEC.sentinels)
    return E.ordinal(view, E.fit_categories(view.where("split = 'train'"), SPEC.ordinal))


@query(
    "en7_standard_scaling",
    f"with {_P} select {_ID_SQL}, split, {', '.join(f'{r(f'({c} - avg_{c}) / std_{c}')} as {c}' for c in SPEC.scaled)} from g_view, p",
)
def en7(t: Marts) -> DataFrame:
    view = t.split_of(*SPEC.scaled).select(*_ID, "split", *SPEC.scaled)
    return E.scale(view, E.fit_scalers(view.where("split = 'train'"), SPEC.scaled))


_ENCODED = ", ".join(
    [f"{r(_scaled(c))} as {c}" for c in SPEC.fills] + [_ORDINAL, _ONE_HOT] + [f'"{c}"' for c in FLAG_NAMES]
)


def _as_doubles(df: DataFrame) -> list:
    return [F.col(c).cast("double").alias(c) for c in SPEC.fills if c in df.columns]


@query("en8_training_preprocessing", f"with {_P} select {_ID_SQL}, label, split, {_ENCODED} from g_view, p")
def en8(t: Marts) -> DataFrame:
    view = t.split_view
    encoded = E.fit_encoders(view.where("split = 'train'")).transform(view)
    others = [c for c in encoded.columns if c not in {*S.ID_COLUMNS, "label", "split", *SPEC.fills}]
    return encoded.select(*_ID, "label", "split", *_as_doubles(encoded), *[F.col(f"`{c}`") for c in others])


@query(
    "en9_inference_preprocessing",
    f"""with {_P} select customer_id, cast(snapshot_date as varchar) as loan_start_date, {_ENCODED} from
 (select f.* from g_feat f left join g_lbl l on f.customer_id = l.customer_id and f.snapshot_date = l.loan_start_date where l.loan_id is null), p""",
)
def en9(t: Marts) -> DataFrame:
    features, labels = t.stored(t.features, "features"), t.stored(t.gold_labels, "labels")
    view = with_split(t, J.labelled_features(features, labels))
    fitted = E.fit_encoders(view.where("split = 'train'"))
    encoded = fitted.transform(J.unlabelled_features(features, labels))
    keep = ("customer_id", "loan_start_date")
    others = [c for c in encoded.columns if c not in {*S.ID_COLUMNS, *SPEC.fills}]
    return encoded.select(*keep, *_as_doubles(encoded), *[F.col(f"`{c}`") for c in others])
