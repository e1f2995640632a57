"""Data drift (population stability, two-sample KS) and metric drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bands import edges_at_or_below
from ..functions.scalars import alert_list, alert_text
from . import ordered
from .evaluate import linspace
from .profile import split_by_type

# The defaults of the monitoring rules.
PSI_THRESHOLD = 0.2
P_VALUE_THRESHOLD = 0.05
METRIC_TOLERANCE = 0.02
EPSILON = 1e-6
SERIES_TERMS = 100

SIDE = "__side"
REFERENCE, CURRENT = 0, 1


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns of the reference that the current side has too, in the reference's order."""
    have = set(current.columns)
    return [c for c in reference.columns if c in have]


def require_inputs(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> list[str]:
    """Both sides must have rows and every feature."""
    missing = [f for f in features if f not in reference.columns or f not in current.columns]
    for name, frame in (("reference", reference), ("current", current)):
        if frame.isEmpty():
            raise ValueError(f"{name} table is empty")
    if missing:
        raise KeyError(f"features not present on both sides: {missing}")
    return list(features)


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows with a usable value: neither null nor NaN."""
    value = F.col(column)
    if column in split_by_type(df, exclude=())[0]:
        return df.where(value.isNotNull() & ~F.isnan(value.cast("double")))
    return df.where(value.isNotNull())


def both_sides(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """One table of both sides with a side tag."""
    return reference.select(*features, F.lit(REFERENCE).alias(SIDE)).unionByName(
        current.select(*features, F.lit(CURRENT).alias(SIDE))
    )


def _side_counts(prefix: str = "") -> list[Column]:
    return [
        F.count_if(F.col(SIDE) == REFERENCE).alias(f"{prefix}reference"),
        F.count_if(F.col(SIDE) == CURRENT).alias(f"{prefix}current"),
    ]


def _psi_sum(counts: DataFrame) -> DataFrame:
    """PSI per feature from the counts of its bins; null when one side has no values."""
    totals = counts.groupBy("feature").agg(F.sum("reference").alias("all_r"), F.sum("current").alias("all_c"))
    p = F.col("reference") / (F.col("all_r") + F.lit(EPSILON))
    q = F.col("current") / (F.col("all_c") + F.lit(EPSILON))
    term = (p - q) * F.log((p + F.lit(EPSILON)) / (q + F.lit(EPSILON)))
    return (
        # One row of totals per feature.
        counts.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(F.when((F.first("all_r") > 0) & (F.first("all_c") > 0), F.sum(term)).alias("psi"))
    )


def numeric_bins(edges: Mapping[str, Sequence[float | None]]) -> dict[str, Column]:
    """Left-closed bin of each feature's value, from its quantile edges; the outer edges are open."""
    out = {}
    for feature, quantiles in edges.items():
        inner = sorted({e for e in quantiles[1:-1] if e is not None})
        out[feature] = edges_at_or_below(F.col(feature).cast("double"), inner)
    return out


def _bin_counts(tagged: DataFrame, numeric: Mapping[str, Column], categorical: Sequence[str]) -> DataFrame:
    """Counts per ``(feature, bin or category)`` and side: the table is unpivoted once and summed map-side."""
    entries = [
        F.struct(F.lit(f).alias("feature"), F.when(_present(f), expr).alias("bin"), F.lit(None).cast("string").alias("category"))
        for f, expr in numeric.items()
    ] + [
        F.struct(F.lit(f).alias("feature"), F.lit(None).cast("int").alias("bin"), F.col(f).cast("string").alias("category"))
        for f in categorical
    ]
    return (
        tagged.select(SIDE, F.explode(F.array(*entries)).alias("e"))
        .select(SIDE, "e.feature", "e.bin", "e.category")
        .where("bin is not null or category is not null")
        .groupBy("feature", "bin", "category")
        .agg(*_side_counts())
    )


def _present(feature: str) -> Column:
    return F.col(feature).isNotNull() & ~F.isnan(F.col(feature).cast("double"))


def psi(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    bins: int = 10,
    cuts: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Population stability index per feature ``(feature, psi)``.

    Numeric features use bins between the reference's quantiles, others (booleans too) one bin per
    value seen on either side. The edges are the only numbers the driver reads.
    """
    features = [*numeric, *categorical]
    edges = ordered.exact_quantiles(reference, numeric, linspace(0.0, 1.0, bins + 1), cuts=cuts) if numeric else {}
    tagged = both_sides(reference, current, features)
    return _psi_by_feature(_bin_counts(tagged, numeric_bins(edges), categorical), edges, features)


def _psi_by_feature(counts: DataFrame, edges: Mapping[str, Sequence[float | None]], features: Sequence[str]) -> DataFrame:
    # Without an inner edge everything lies in one bin, and nothing can differ.
    flat = [f for f, q in edges.items() if not {e for e in q[1:-1] if e is not None}]
    value = F.when(F.col("feature").isin(flat) & F.col("psi").isNotNull(), F.lit(0.0)).otherwise(F.col("psi"))
    names = counts.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(_psi_sum(counts).withColumn("psi", value), "feature", "left")


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Two-sided p-value of the Kolmogorov series at the effective size, with Stephens' correction."""
    size = F.sqrt(n * m / (n + m))
    lam = (size + F.lit(0.12) + F.lit(0.11) / size) * d
    term = lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), F.lit(0.0), lambda total, k: total + term(k))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_two_sample(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    cuts: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Largest distance of the two distribution functions and its p-value, per feature.

    Null when a side is empty, or when both sides are constant. The p-value is the Kolmogorov series
    for samples of any size.
    """
    features = list(features)
    tagged = both_sides(reference, current, features)
    cuts = {f: cuts[f] for f in features} if cuts else ordered.cut_points(tagged, features)
    long = ordered.long_values(tagged, cuts, carry=[SIDE], numbered=True)
    found = _ks_by_feature(long, {"r": F.count_if(F.col(SIDE) == REFERENCE), "c": F.count_if(F.col(SIDE) == CURRENT)}, list(cuts))
    names = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(found, "feature", "left")


def _ks_by_feature(long: DataFrame, sums: Mapping[str, Column], features: Sequence[str]) -> DataFrame:
    """Distance and p-value of numbered features from rows ``(feature, bucket, value)`` with the counts ``r`` and ``c``."""
    run = ordered.running_sums(long, sums, by=["feature"])
    gap = F.abs(F.try_divide(F.col("run_r"), F.col("all_r")) - F.try_divide(F.col("run_c"), F.col("all_c")))
    varies = lambda side: F.min(F.when(F.col(side) > 0, F.col("value"))) < F.max(F.when(F.col(side) > 0, F.col("value")))
    by_feature = run.groupBy("feature").agg(
        F.max(gap).alias("d"),
        F.max("all_r").alias("n"),
        F.max("all_c").alias("m"),
        varies("r").alias("varies_r"),
        varies("c").alias("varies_c"),
    )
    usable = (F.col("n") > 0) & (F.col("m") > 0) & (F.col("varies_r") | F.col("varies_c"))
    p_value = ks_p_value(F.col("d"), F.col("n").cast("double"), F.col("m").cast("double"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    return by_feature.where(usable).select(name.alias("feature"), F.col("d").alias("ks_statistic"), p_value.alias("ks_pvalue"))


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    psi_threshold: float = PSI_THRESHOLD,
    p_threshold: float = P_VALUE_THRESHOLD,
) -> DataFrame:
    """One row per feature: PSI, KS distance and p-value, alerts."""
    names = require_inputs(reference, current, features or common_columns(reference, current))
    in_reference = split_by_type(reference.select(*names), exclude=())[0]
    in_current = split_by_type(current.select(*names), exclude=())[0]
    numeric = [f for f in names if f in in_reference and f in in_current]
    categorical = [f for f in names if f not in numeric]
    cuts = ordered.cut_points(both_sides(reference, current, numeric), numeric) if numeric else {}
    result = psi(reference, current, numeric, categorical, cuts=cuts)
    if numeric:
        result = result.join(F.broadcast(ks_two_sample(reference, current, numeric, cuts)), "feature", "left")
    else:
        result = result.withColumns({c: F.lit(None).cast("double") for c in ("ks_statistic", "ks_pvalue")})
    return _with_alerts(result, psi_threshold, p_threshold)


def _with_alerts(result: DataFrame, psi_threshold: float, p_threshold: float) -> DataFrame:
    result = result.withColumn("alerts", alert_list(F.col("psi"), F.col("ks_pvalue"), psi_threshold, p_threshold))
    return result.select(
        "feature", "psi", "ks_statistic", "ks_pvalue", "alerts",
        (F.size("alerts") > 0).alias("has_alert"), alert_text("alerts").alias("alert_text"),
    )


@dataclass
class StoredReference:
    """What drift needs of a reference: its counts per distinct value and per bin, its edges, rows and times.

    ``values (feature, bucket, value, n)`` are the numeric features by position with the buckets between ``cuts``; ``bins
    (feature, bin, category, reference)`` are counts between the quantile ``edges`` and of the categories.
    """

    numeric: list[str]
    categorical: list[str]
    edges: dict[str, list[float | None]]
    cuts: dict[str, list[float]]
    metadata: DataFrame
    values: DataFrame
    bins: DataFrame

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def store_reference(
    reference: DataFrame, features: Sequence[str] | None, path: str, bins: int = 10, time_column: str = "event_time"
) -> StoredReference:
    """Write the counts of a reference once; ``load_reference`` gives them back, and the reference is not read again."""
    names = list(features or reference.columns)
    if reference.isEmpty():
        raise ValueError("reference table is empty")
    spark = reference.sparkSession
    numeric = [f for f in names if f in split_by_type(reference.select(*names), exclude=())[0]]
    categorical = [f for f in names if f not in numeric]
    cuts = ordered.cut_points(reference, numeric) if numeric else {}
    edges = ordered.exact_quantiles(reference, numeric, linspace(0.0, 1.0, bins + 1), cuts=cuts) if numeric else {}
    if numeric:
        values = ordered.long_values(reference.select(*numeric), cuts, numbered=True).groupBy("feature", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
        values.write.mode("overwrite").parquet(f"{path}/values")
    tagged = reference.select(*names, F.lit(REFERENCE).alias(SIDE))
    _bin_counts(tagged, numeric_bins(edges), categorical).drop("current").write.mode("overwrite").parquet(f"{path}/bins")
    side_metadata(reference, reference, time_column).where("side = 'reference'").write.mode("overwrite").parquet(f"{path}/metadata")
    kinds = "numeric array<string>, categorical array<string>, edges map<string, array<double>>, cuts map<string, array<double>>"
    spark.createDataFrame([(numeric, categorical, edges, cuts)], kinds).write.mode("overwrite").parquet(f"{path}/settings")
    return load_reference(spark, path)


def load_reference(spark: SparkSession, path: str) -> StoredReference:
    kept = spark.read.parquet(f"{path}/settings").first()
    none = "feature int, bucket int, value double, n long"
    values = spark.read.parquet(f"{path}/values") if kept["numeric"] else spark.createDataFrame([], none)
    return StoredReference(
        list(kept["numeric"]), list(kept["categorical"]), dict(kept["edges"]), dict(kept["cuts"]),
        spark.read.parquet(f"{path}/metadata"), values, spark.read.parquet(f"{path}/bins"),
    )


def drift_from_reference(
    stored: StoredReference, current: DataFrame, psi_threshold: float = PSI_THRESHOLD, p_threshold: float = P_VALUE_THRESHOLD
) -> DataFrame:
    """``feature_drift`` against stored counts: the same rows, without reading the reference."""
    missing = [f for f in stored.features if f not in current.columns]
    if missing:
        raise KeyError(f"features not present on both sides: {missing}")
    if current.isEmpty():
        raise ValueError("current table is empty")
    changed = set(stored.numeric) - set(split_by_type(current.select(*stored.features), exclude=())[0])
    if changed:
        raise ValueError(f"numeric in the reference only: {sorted(changed)}")
    tagged = current.select(*stored.features, F.lit(CURRENT).alias(SIDE))
    now = _bin_counts(tagged, numeric_bins(stored.edges), stored.categorical)
    zero = F.lit(0).cast("long")
    both = stored.bins.withColumn("current", zero).unionByName(now.withColumn("reference", zero))
    both = both.groupBy("feature", "bin", "category").agg(F.sum("reference").alias("reference"), F.sum("current").alias("current"))
    result = _psi_by_feature(both, stored.edges, stored.features)
    if stored.numeric:
        mine = ordered.long_values(current.select(*stored.numeric), stored.cuts, numbered=True).select("feature", "bucket", "value", zero.alias("r"), F.lit(1).cast("long").alias("c"))
        theirs = stored.values.select("feature", "bucket", "value", F.col("n").alias("r"), zero.alias("c"))
        found = _ks_by_feature(theirs.unionByName(mine), {"r": F.sum("r"), "c": F.sum("c")}, stored.numeric)
        result = result.join(F.broadcast(found), "feature", "left")
    else:
        result = result.withColumns({c: F.lit(None).cast("double") for c in ("ks_statistic", "ks_pvalue")})
    return _with_alerts(result, psi_threshold, p_threshold)


def performance_drift(
    baseline: DataFrame, current: DataFrame, tolerances: DataFrame | None = None, default: float = METRIC_TOLERANCE
) -> DataFrame:
    """Compare two ``(metric, value)`` tables; a metric on one side only raises an alert.

    ``tolerances`` is ``(metric, tolerance)``.
    """
    joined = baseline.select("metric", F.col("value").cast("double").alias("baseline")).join(
        current.select("metric", F.col("value").cast("double").alias("current")), "metric", "full"
    )
    if tolerances is not None:
        joined = joined.join(tolerances.select("metric", F.col("tolerance").cast("double").alias("given")), "metric", "left")
        joined = joined.withColumn("tolerance", F.coalesce("given", F.lit(float(default))))
    else:
        joined = joined.withColumn("tolerance", F.lit(float(default)))
    delta = F.col("current") - F.col("baseline")
    return (
        joined.withColumn("delta", delta)
        .withColumn("alert", F.coalesce(F.abs("delta") > F.col("tolerance"), F.lit(True)))
        .select("metric", "baseline", "current", "delta", "tolerance", "alert")
        .orderBy("metric")
    )


def side_metadata(reference: DataFrame, current: DataFrame, time_column: str = "event_time") -> DataFrame:
    """Row count and time range per side; the range is null where the column is absent."""
    parts = []
    kinds = [f.schema[time_column].dataType.simpleString() for f in (reference, current) if time_column in f.columns]
    for name, frame in (("reference", reference), ("current", current)):
        ts = F.col(time_column) if time_column in frame.columns else F.lit(None).cast(kinds[0] if kinds else "timestamp")
        parts.append(
            frame.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("time_min"), F.max(ts).alias("time_max")).select(
                F.lit(name).alias("side"), "rows", "time_min", "time_max"
            )
        )
    return parts[0].unionByName(parts[1])


def category_counts(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Counts per category of either side, 0 where a side lacks it."""
    tagged = both_sides(reference, current, [column])
    return drop_missing(tagged, column).groupBy(column).agg(*_side_counts())
