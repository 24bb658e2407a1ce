"""Encoders fitted on the training rows and applied as plain projections.

A fit collects only parameters (one number per column and statistic, or the list
of categories of a column); applying it never joins, shuffles or leaves the JVM.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import FeatureHasher
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions import numbers as N, text as X
from .cleaning import map_columns
from .order_stats import approx_quantiles, exact_quantiles

HASHED_COLUMN = "hashed_categories"


@dataclass(frozen=True)
class EncoderSpec:
    """One-hot and ordinal columns become a column or a branch per category, so their categories are
    parameters on the driver.  Columns with categories without number go to ``hashed``: one
    sparse vector for all of them, without any fit.
    """

    caps: tuple[str, ...] = S.CAP_COLUMNS
    cap_probability: float = S.CAP_PROBABILITY
    fills: tuple[str, ...] = (*S.FILL_COLUMNS, *S.EXTRA_FILL_COLUMNS)
    one_hot: tuple[str, ...] = S.ONE_HOT_COLUMNS
    ordinal: tuple[str, ...] = S.ORDINAL_COLUMNS
    scaled: tuple[str, ...] = S.SCALED_COLUMNS
    sentinels: dict[str, str] = field(default_factory=lambda: dict(S.ENCODING_SENTINELS))
    # "raw": scalers see the training rows as stored; "processed": after cap and fill
    fit_scalers_on: str = "raw"
    quantiles: str = "exact"
    hashed: tuple[str, ...] = ()

    def present_in(self, columns) -> "EncoderSpec":
        """The same spec limited to columns a frame has."""
        have = set(columns)
        keep = lambda names: tuple(c for c in names if c in have)
        return EncoderSpec(
            keep(self.caps),
            self.cap_probability,
            keep(self.fills),
            keep(self.one_hot),
            keep(self.ordinal),
            keep(self.scaled),
            {c: v for c, v in self.sentinels.items() if c in have},
            self.fit_scalers_on,
            self.quantiles,
            keep(self.hashed),
        )


@dataclass
class FittedEncoders:
    caps: dict[str, float | None]
    fills: dict[str, float | None]
    one_hot: dict[str, list[str | None]]
    ordinal: dict[str, list[str | None]]
    scalers: dict[str, tuple[float | None, float | None]]
    sentinels: dict[str, str]
    hashed: list[str] = field(default_factory=list)

    PARAM_SCHEMA = "encoder string, column string, position int, value string"

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [("cap", c, 0, _text(v)) for c, v in self.caps.items()]
        rows += [("fill", c, 0, _text(v)) for c, v in self.fills.items()]
        for kind, lists in (("one_hot", self.one_hot), ("ordinal", self.ordinal)):
            rows += [(kind, c, i, v) for c, values in lists.items() for i, v in enumerate(values)]
        rows += [("scale", c, i, _text(v)) for c, pair in self.scalers.items() for i, v in enumerate(pair)]
        rows += [("sentinel", c, 0, v) for c, v in self.sentinels.items()]
        rows += [("hashed", c, i, None) for i, c in enumerate(self.hashed)]
        return spark.createDataFrame(rows, self.PARAM_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> "FittedEncoders":
        out = cls({}, {}, {}, {}, {}, {})
        # order of parameters is the order of columns in the model's vector
        for r in table.orderBy("encoder", "column", "position").collect():
            c, v = r["column"], r["value"]
            if r["encoder"] == "cap":
                out.caps[c] = _number(v)
            elif r["encoder"] == "fill":
                out.fills[c] = _number(v)
            elif r["encoder"] == "one_hot":
                out.one_hot.setdefault(c, []).append(v)
            elif r["encoder"] == "ordinal":
                out.ordinal.setdefault(c, []).append(v)
            elif r["encoder"] == "scale":
                out.scalers[c] = (*out.scalers.get(c, ()), _number(v))
            elif r["encoder"] == "hashed":
                out.hashed.append(c)
            else:
                out.sentinels[c] = v
        return out

    def transform(self, df: DataFrame, keep_ids: bool = True) -> DataFrame:
        """cap -> fill -> one-hot -> ordinal -> scale -> hash; ids are dropped on request."""
        df = cap_outliers(df, self.caps)
        df = fill_nulls(df, self.fills)
        df = null_sentinels(df, self.sentinels)
        df = one_hot(df, self.one_hot)
        df = ordinal(df, self.ordinal)
        df = scale(df, self.scalers)
        df = hash_categories(df, self.hashed)
        return df if keep_ids else df.drop(*S.ID_COLUMNS)

    def feature_columns(self, encoded: DataFrame, label: str = "label") -> list[str]:
        """Columns of an encoded frame that enter the model, by name for a stable vector."""
        skip = {*S.ID_COLUMNS, label, "split", "fold"}
        return sorted(c for c in encoded.columns if c not in skip)


def _text(v) -> str | None:
    return None if v is None else json.dumps(v)


def _number(v) -> float | None:
    return None if v is None else json.loads(v)


# --- fit ----------------------------------------------------------------------
def fit_quantiles(train: DataFrame, spec: EncoderSpec):
    """Caps and fill values of all columns, sharing every pass over the rows."""
    wanted = {
        c: [p for p, names in ((spec.cap_probability, spec.caps), (0.5, spec.fills)) if c in names]
        for c in dict.fromkeys((*spec.caps, *spec.fills))
    }
    if not wanted:
        return {}, {}
    if spec.quantiles == "exact":
        values = exact_quantiles(train, wanted)
    else:
        values = approx_quantiles(train, wanted)
    return (
        {c: values[c][spec.cap_probability] for c in spec.caps},
        {c: values[c][0.5] for c in spec.fills},
    )


def fit_categories(train: DataFrame, columns) -> dict[str, list[str | None]]:
    """Sorted categories per column, NULL last where it occurs; one job for all columns."""
    columns = list(columns)
    if not columns:
        return {}
    long = train.select(*[F.col(c).cast("string").alias(c) for c in columns])
    out: dict[str, list[str | None]] = {c: [] for c in columns}
    for r in long.unpivot([], columns, "column", "value").distinct().collect():
        out[r["column"]].append(r["value"])
    return {
        c: sorted(v for v in values if v is not None) + ([None] if None in values else []) for c, values in out.items()
    }


def fit_scalers(train: DataFrame, columns) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population standard deviation of every column in one aggregate."""
    columns = list(columns)
    if not columns:
        return {}
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def fit_encoders(train: DataFrame, spec: EncoderSpec = EncoderSpec()) -> FittedEncoders:
    spec = spec.present_in(train.columns)
    caps, fills = fit_quantiles(train, spec)
    categories = fit_categories(null_sentinels(train, spec.sentinels), (*spec.one_hot, *spec.ordinal))
    scaler_rows = train
    if spec.fit_scalers_on == "processed":
        scaler_rows = fill_nulls(cap_outliers(train, caps), fills)
    return FittedEncoders(
        caps,
        fills,
        {c: categories[c] for c in spec.one_hot},
        {c: categories[c] for c in spec.ordinal},
        fit_scalers(scaler_rows, spec.scaled),
        spec.sentinels,
        list(spec.hashed),
    )


# --- apply --------------------------------------------------------------------
def cap_outliers(df: DataFrame, caps: dict[str, float | None]) -> DataFrame:
    return _replace(df, {c: N.cap_at(F.col(c), v) for c, v in caps.items() if v is not None})


def fill_nulls(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return _replace(df, {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def null_sentinels(df: DataFrame, sentinels: dict[str, str]) -> DataFrame:
    return _replace(df, {c: X.sentinel_to_null(F.col(c), v) for c, v in sentinels.items()})


def one_hot_name(column: str, category: str | None) -> str:
    return f"{column}_{category}"


def one_hot(df: DataFrame, categories: dict[str, list[str | None]]) -> DataFrame:
    """One 0/1 column per known category; an unseen value is all zeros."""
    new = {
        one_hot_name(c, v): F.col(c).eqNullSafe(F.lit(v)).cast("double")
        for c, values in categories.items()
        if c in df.columns
        for v in values
    }
    return df.withColumns(new).drop(*categories) if new else df


def ordinal_code(c: Column, categories: list[str | None]) -> Column:
    """Position among the sorted categories; -1 for a value not seen at fit."""
    known = [v for v in categories if v is not None]
    codes = F.lit(-1.0)
    if known:
        table = F.create_map(*[F.lit(x) for i, v in enumerate(known) for x in (v, float(i))])
        codes = F.coalesce(F.try_element_at(table, c), F.lit(-1.0))
    null_code = float(len(known)) if None in categories else -1.0
    return F.when(c.isNull(), F.lit(null_code)).otherwise(codes)


def ordinal(df: DataFrame, categories: dict[str, list[str | None]]) -> DataFrame:
    return _replace(df, {c: ordinal_code(F.col(c), values) for c, values in categories.items()})


def scale(df: DataFrame, scalers: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    return _replace(df, {c: N.standardise(F.col(c), *pair) for c, pair in scalers.items()})


def hash_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """One sparse vector of hashed categories in place of the columns."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    return FeatureHasher(inputCols=columns, outputCol=HASHED_COLUMN, categoricalCols=columns).transform(df).drop(*columns)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    new = {c: expr for c, expr in new.items() if c in df.columns}
    return df.withColumns(new) if new else df
