"""Classification metrics and rate monitoring as single aggregates over hard predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import share

# fixed value: alert when the two positive rates are further apart (in percent)
RATE_ALERT_PERCENT = 40.0


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by=()) -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    aggs = [
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def recall() -> Column:
    return F.coalesce(share(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))


def f1() -> Column:
    return F.coalesce(share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def auc() -> Column:
    """Area under the two-segment curve of hard labels; NULL with a single class."""
    tpr = share(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = share(F.col("tn"), F.col("tn") + F.col("fp"))
    return (tpr + tnr) / 2.0


def accuracy() -> Column:
    hits = F.col("tp") + F.col("tn")
    return share(hits, hits + F.col("fp") + F.col("fn"))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by=()) -> DataFrame:
    """recall, f1, auc, gini and accuracy of class 1, optionally per group."""
    counted = confusion(df, label, prediction, by)
    return counted.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        recall().alias("recall"),
        f1().alias("f1"),
        auc().alias("auc"),
        (2 * auc() - 1).alias("gini"),
        accuracy().alias("accuracy"),
    )


def evaluation_by_split(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """train (train + valid rows), test and oot metrics; gini rounded to 3 digits."""
    part = F.when(F.col("split").isin("train", "valid"), "train").otherwise(F.col("split"))
    metrics = binary_metrics(scored.withColumn("part", part), label, prediction, by=("part",))
    return metrics.select(
        F.col("part").alias("split"), "recall", "f1", F.round("gini", 3).alias("gini"), "accuracy"
    )


def class_counts(df: DataFrame, column: str, by=()) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(column) == 1).alias("n_1"),
        F.count_if(F.col(column) == 0).alias("n_0"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive: the positive-class weight of boosted trees."""
    counts = class_counts(df, label)
    return counts.select("n_0", "n_1", share(F.col("n_0"), F.col("n_1")).alias("scale_pos_weight"))


def result_rates(labels: DataFrame, predictions: DataFrame, by: str = "run_date") -> DataFrame:
    """Positive and negative counts of both tables per run, from one aggregate over their union."""
    tagged = labels.select(by, F.col("label").alias("y"), F.lit(True).alias("is_label")).unionByName(
        predictions.select(by, F.col("prediction").alias("y"), F.lit(False).alias("is_label"))
    )
    is_label, y = F.col("is_label"), F.col("y")
    counted = tagged.groupBy(by).agg(
        F.count_if(is_label).alias("label_count"),
        F.count_if(is_label & (y == 1)).alias("label_1"),
        F.count_if(is_label & (y == 0)).alias("label_0"),
        F.count_if(~is_label).alias("result_count"),
        F.count_if(~is_label & (y == 1)).alias("result_1"),
        F.count_if(~is_label & (y == 0)).alias("result_0"),
    )
    return counted.withColumns(
        {
            "labels_percent": share(F.col("label_1"), F.col("label_count")),
            "results_percent": share(F.col("result_1"), F.col("result_count")),
        }
    )


def rate_alerts(rates: DataFrame, threshold_percent: float = RATE_ALERT_PERCENT) -> DataFrame:
    gap = F.abs(F.col("labels_percent") - F.col("results_percent")) * 100
    return rates.withColumns(
        {"gap_percent": gap, "alert": F.coalesce(gap > threshold_percent, F.lit(False))}
    )


def threshold_checks(record: DataFrame, metrics=("recall", "f1", "gini")) -> DataFrame:
    """One boolean per metric: the score fell below the active model's threshold."""
    return record.withColumns(
        {f"{m}_below": F.coalesce(F.col(m) < F.col(f"{m}_threshold"), F.lit(False)) for m in metrics}
    )
