"""Two-key equi-joins of the marts, written so that a hot key cannot sink them.

Spark splits a skewed shuffle partition at run time for inner joins (either
side) and for the preserved side of left/anti joins, but never for full outer
joins and never for the non-preserved side.  So every outer join is put together
from parts it can split, whatever the size of the inputs:

    inner part  +  left rows without partner  (+ right rows without partner)

The inner and the anti part read the same exchange.  Rows with a NULL key have no partner
by definition; they bypass the shuffle.  As the parts read their inputs several times, an input that
is more than a filtered scan of a table is written first: nothing is computed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import compiled_methods, stored


def _all_present(keys) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _any_null(keys) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def is_scan(df: DataFrame) -> bool:
    """Whether a plan only reads, filters and projects one stored table."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def as_table(df: DataFrame) -> DataFrame:
    if is_scan(df):
        return df
    with compiled_methods(df.sparkSession):
        return stored(df, "side")


def distinct_keys(df: DataFrame, keys) -> DataFrame:
    """The non-NULL keys of a frame, at most once per map task.

    Grouping on (keys, task) collapses a hot key before the shuffle without
    fixing the partitioning to the keys, so the join above it keeps a plain
    exchange that AQE can split.
    """
    return (
        df.where(_all_present(keys))
        .select(*keys, F.spark_partition_id().alias("_task"))
        .distinct()
        .select(*keys)
    )


def unmatched(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``; a NULL key equals none, so its rows stay.

    ``left`` is read once, and only the columns asked for later; AQE may split any of its keys, NULL too.
    """
    keys = list(keys)
    return left.join(distinct_keys(right, keys), keys, "left_anti")


def outer_join(left: DataFrame, right: DataFrame, keys, how: str = "outer") -> DataFrame:
    """Left or full outer USING join with coalesced keys, safe for hot keys on both sides."""
    keys = list(keys)
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared:
        raise ValueError(f"both sides have non-key columns {sorted(shared)}")
    if how not in ("left", "outer"):
        raise ValueError(f"unsupported join type {how!r}")
    left, right = as_table(left), as_table(right)
    left_present, right_present = left.where(_all_present(keys)), right.where(_all_present(keys))
    parts = [
        left_present.join(right_present, keys, "inner"),
        left_present.join(distinct_keys(right, keys), keys, "left_anti"),
        left.where(_any_null(keys)),
    ]
    if how == "outer":
        parts += [right_present.join(distinct_keys(left, keys), keys, "left_anti"), right.where(_any_null(keys))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


LABEL_KEYS = ("customer_id", "loan_start_date")


def as_application_features(features: DataFrame) -> DataFrame:
    """Name the snapshot month of a feature row as the loan start it can serve."""
    return features.withColumnsRenamed({"snapshot_date": "loan_start_date"}).withColumn(
        "feature_snapshot_date", F.col("loan_start_date")
    )


def as_label_side(labels: DataFrame) -> DataFrame:
    return labels.withColumnRenamed("snapshot_date", "label_snapshot_date")


def attach_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Every feature row with its later label, if any.

    Features are matched on the loan start, never on the month the label became
    known, so nothing observed after the application leaks in.
    """
    return outer_join(as_application_features(features), as_label_side(labels), LABEL_KEYS, "left")


def labelled_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    return as_application_features(features).join(as_label_side(labels), list(LABEL_KEYS), "inner")


def unlabelled_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows without a label: the population to score."""
    return unmatched(as_application_features(features), as_label_side(labels), LABEL_KEYS)


def snapshot_features_with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Exploratory variant: label of the same snapshot month."""
    return outer_join(features, labels, ("customer_id", "snapshot_date"), "left")


def labels_with_predictions(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    return labels.join(predictions, list(LABEL_KEYS), "inner")


def features_by_snapshot(attributes: DataFrame, financials: DataFrame) -> DataFrame:
    return outer_join(attributes, financials, ("customer_id", "snapshot_date"))
