"""Population stability index (PSI) of features against a reference population.

Bin edges are exact quantiles of the reference.  Binning is a chain of
comparisons against the edges inside codegen (tied edges need no special case),
and counting is one partial aggregate of eleven counters per (period, feature).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .order_stats import exact_quantiles

# fixed values
BUCKETS = 10
EMPTY_SHARE = 0.0001
MODERATE_PSI = 0.1
SIGNIFICANT_PSI = 0.2
DRIFT_STATUS = ("No significant drift", "Moderate drift", "Significant drift")
ADVICE = (
    "Model is stable - continue monitoring",
    "Moderate drift - monitor closely",
    "Significant drift detected - consider model retraining",
)


@dataclass(frozen=True)
class Reference:
    """Edges and bin shares of the reference population, a few numbers per feature."""

    edges: dict[str, list[float]]
    shares: dict[str, list[float]]

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, self.edges[f], self.shares[f]) for f in self.edges]
        return spark.createDataFrame(rows, "feature string, edges array<double>, shares array<double>")

    @classmethod
    def from_table(cls, table: DataFrame) -> "Reference":
        rows = table.collect()
        return cls({r["feature"]: list(r["edges"]) for r in rows}, {r["feature"]: list(r["shares"]) for r in rows})


def bin_index(c: Column, edges: list[float]) -> Column:
    """0-based bin of a value: [e_i, e_i+1), the last one closed; -1 outside; NULL stays NULL."""
    x = c.cast("double")
    # a chain of short tests: generated methods beyond 8000 bytes are never compiled to machine code
    at = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, e in enumerate(edges[:-1]):
        at = at.when(x < F.lit(float(e)), i - 1)
    return at.when(x > F.lit(float(edges[-1])), -1).otherwise(len(edges) - 2)


def bin_counts(df: DataFrame, edges: dict[str, list[float]], by=()) -> DataFrame:
    """(by, feature, n, counts[10]) of all features in one pass.

    A feature the frame lacks is left out.  n counts every non-NULL value, also
    those outside all bins.
    """
    features = [f for f in edges if f in df.columns]
    if not features:
        none = F.lit(None)
        empty = df.select(*by, none.cast("string").alias("feature"), none.cast("long").alias("n"), none.cast("array<bigint>").alias("counts"))
        return empty.limit(0)
    binned = df.select(*by, *[_present_bin(F.col(f), edges[f]).alias(f) for f in features])
    long = binned.unpivot(list(by), features, "feature", "bin")
    b = F.col("bin")
    buckets = max(len(e) for e in edges.values()) - 1
    # one counter a value; the few sums of bins are turned into arrays afterwards
    counted = long.groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("rows"))
    return counted.groupBy(*by, "feature").agg(
        F.coalesce(F.sum(F.when(b.isNotNull(), F.col("rows"))), F.lit(0)).alias("n"),
        F.array(*[F.coalesce(F.sum(F.when(b == i, F.col("rows"))), F.lit(0)) for i in range(buckets)]).alias("counts"),
    )


def _present_bin(c: Column, edges: list[float]) -> Column:
    return F.when(~F.isnan(c.cast("double")), bin_index(c, edges))


def bin_shares(counted: DataFrame) -> DataFrame:
    """Add ``shares``: counts / n with empty bins lifted to a small share."""
    n = F.col("n").cast("double")
    shares = F.transform(
        F.col("counts"), lambda k: F.when(k == 0, F.lit(EMPTY_SHARE)).otherwise(F.try_divide(k.cast("double"), n))
    )
    return counted.withColumn("shares", shares)


def fit_reference(reference: DataFrame, features, buckets: int = BUCKETS) -> Reference:
    """Edges and shares of every feature; features without any value are left out."""
    clean = reference.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features])
    probs = [i / buckets for i in range(buckets + 1)]
    quantiles = exact_quantiles(clean, {f: probs for f in features})
    edges = {f: [q[p] for p in probs] for f, q in quantiles.items() if q[0.0] is not None}
    if not edges:
        return Reference({}, {})
    rows = bin_shares(bin_counts(clean, edges)).select("feature", "shares").collect()
    return Reference(edges, {r["feature"]: list(r["shares"]) for r in rows})


def psi_value(actual: Column, expected: Column) -> Column:
    """Sum over bins of (a - e) * ln(a / e) for two share arrays."""
    terms = F.zip_with(actual, expected, lambda a, e: (a - e) * F.ln(a / e))
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)


def merged_counts(counted: DataFrame, by=(), buckets: int = BUCKETS) -> DataFrame:
    """Counts of longer periods or fewer groups from those of their parts: sums of n and of every bin."""
    sums = F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(buckets)])
    return counted.groupBy(*by, "feature").agg(F.sum("n").alias("n"), sums.alias("counts"))


def psi_of_counts(counted: DataFrame, reference: Reference, by=()) -> DataFrame:
    """(by, feature, psi) from bin counts; a feature without values has none."""
    if not reference.shares:
        return counted.limit(0).select(*by, "feature", F.lit(0.0).alias("psi"))
    actual = bin_shares(counted.where(F.col("n") > 0))
    expected = F.create_map(
        *[
            x
            for f, shares in reference.shares.items()
            for x in (F.lit(f), F.array(*[F.lit(float(s)) for s in shares]))
        ]
    )
    return actual.select(
        *by, "feature", psi_value(F.col("shares"), F.try_element_at(expected, F.col("feature"))).alias("psi")
    )


def feature_psi(current: DataFrame, reference: Reference, by=()) -> DataFrame:
    """(by, feature, psi) for every feature both sides have."""
    return psi_of_counts(bin_counts(current, reference.edges, by), reference, by)


def drift_status(psi: Column) -> Column:
    return (
        F.when(psi < MODERATE_PSI, DRIFT_STATUS[0])
        .when(psi < SIGNIFICANT_PSI, DRIFT_STATUS[1])
        .otherwise(DRIFT_STATUS[2])
    )


def overall_psi(psi: DataFrame, date: str = "date") -> DataFrame:
    """(date, overall_psi, drift_status): mean over features per period."""
    return (
        psi.groupBy(date)
        .agg(F.avg("psi").alias("overall_psi"))
        .withColumn("drift_status", drift_status(F.col("overall_psi")))
    )


def last_records(records: DataFrame, n: int, date: str = "date") -> DataFrame:
    return records.orderBy(F.col(date).desc()).limit(n)


def recent(psi: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Feature rows of the last n periods; the n dates are a bounded list."""
    dates = last_records(psi.select(date).distinct(), n, date)
    return psi.join(dates, date, "left_semi")


def dense_feature_psi(psi: DataFrame, features, date: str = "date") -> DataFrame:
    """(date, feature, psi, overall_psi) for every period and model feature; missing psi is 0."""
    wanted = F.explode(F.array(*[F.lit(f) for f in features]))
    grid = overall_psi(psi, date).select(date, "overall_psi", wanted.alias("feature"))
    return grid.join(psi.select(date, "feature", "psi"), [date, "feature"], "left").fillna(0.0, ["psi"])


def average_feature_psi(dense: DataFrame) -> DataFrame:
    """Mean PSI per model feature, highest first."""
    return (
        dense.groupBy("feature")
        .agg(F.avg("psi").alias("avg_psi"))
        .orderBy(F.col("avg_psi").desc(), "feature")
    )


def status_distribution(overall: DataFrame) -> DataFrame:
    """Periods per drift status and their share; the window runs over three rows at most."""
    counts = overall.groupBy("drift_status").agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("records") / total)


def pearson(a: Column, b: Column) -> Column:
    """Correlation; NULL where a side is constant (``corr`` raises under ANSI)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def drift_correlation(dense: DataFrame, n: int = 5) -> DataFrame:
    """The n features whose PSI moves most with the overall PSI, by absolute correlation."""
    scored = dense.groupBy("feature").agg(pearson(F.col("psi"), F.col("overall_psi")).alias("correlation"))
    return scored.orderBy(F.abs("correlation").desc_nulls_last(), "feature").limit(n)


def report_summary(overall: DataFrame, reference_rows: int) -> DataFrame:
    """One row: rows compared with, average, highest and lowest overall PSI and the recommendation."""
    top = F.max("overall_psi")
    return overall.agg(
        F.lit(reference_rows).cast("long").alias("reference_rows"),
        F.count(F.lit(1)).alias("records"),
        F.avg("overall_psi").alias("avg_psi"),
        top.alias("max_psi"),
        F.min("overall_psi").alias("min_psi"),
        F.when(top > SIGNIFICANT_PSI, ADVICE[2])
        .when(top > MODERATE_PSI, ADVICE[1])
        .otherwise(ADVICE[0])
        .alias("recommendation"),
    )


def high_drift_features(psi: DataFrame, threshold: float = SIGNIFICANT_PSI) -> DataFrame:
    """Features whose PSI passed the threshold in some period, highest first."""
    return (
        psi.groupBy("feature")
        .agg(F.max("psi").alias("max_psi"))
        .where(F.col("max_psi") > threshold)
        .orderBy(F.col("max_psi").desc(), "feature")
    )
