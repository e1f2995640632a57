"""Counts and shares by label or category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .ordered import grouped_quantiles


def class_balance(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Count and share of each label, within ``by``; one pass, the window sees one row per label."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def balance_map(df: DataFrame, label: str = "label", by: str = "dataset") -> DataFrame:
    """The same in nested form: one row per ``by`` with a map from label to share."""
    flat = class_balance(df, label, [by])
    entry = F.struct(F.coalesce(F.col(label).cast("string"), F.lit("null")), F.col("ratio"))
    return flat.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("balance"))


def value_share(df: DataFrame, column: str, names: Mapping[object, str] | None = None) -> DataFrame:
    """Count and share per value, largest first; ``names`` renames the values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    # A column may have many values, so the total is a scalar and not a window over all of them.
    shares = counts.withColumn("share", F.col("count") / counts.agg(F.sum("count")).scalar())
    if names:
        shown = F.col(column).cast("string")
        for value, name in names.items():
            shown = F.when(F.col(column) == F.lit(value), F.lit(name)).otherwise(shown)
        shares = shares.withColumn(column, shown)
    return shares.orderBy(F.desc("share"), F.asc(column))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts per pair of values, long form."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts with one column per named value."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == F.lit(v)).alias(f"{column}_{v}") for v in values])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight ``total / (classes * count)`` per class; rows without a label count for the total only."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count(label).alias("k"))).scalar()
    return counts.where(F.col(label).isNotNull()).select(
        label, "n", (total.getField("n") / (total.getField("k") * F.col("n"))).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight", limit: int = 1000) -> DataFrame:
    """Put each row's class weight on the row.

    The weights of a classifier's few classes become constants in the plan; with more than ``limit``
    classes they are joined instead.
    """
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    rows = weights.limit(limit + 1).collect()
    if len(rows) > limit:
        return df.join(weights, label, "left")
    expr = F.lit(None).cast("double")
    for row in rows:
        expr = F.when(F.col(label) == F.lit(row[0]), F.lit(row[1])).otherwise(expr)
    return df.withColumn(out, expr)


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive, null without positives."""
    pos = F.count_if(F.col(label) == 1)
    return df.agg(pos.alias("positives"), F.count_if(F.col(label) != 1).alias("negatives")).select(
        "positives", "negatives", F.try_divide(F.col("negatives"), F.col("positives")).alias("pos_weight")
    )


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; missing parts of a key equal each other."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def latency_summary(runs: DataFrame, by: Sequence[str], seconds: str, batch: int) -> DataFrame:
    """Mean, population deviation and throughput of timed runs per model or device, with the exact median."""
    moments = runs.groupBy(*by).agg(
        F.count(seconds).alias("runs"),
        F.avg(seconds).alias("mean_seconds"),
        F.stddev_pop(seconds).alias("std_seconds"),
    )
    medians = grouped_quantiles(runs, by, seconds, [0.5]).select(*by, F.col("quantiles")[0].alias("median_seconds"))
    return moments.join(medians, list(by)).withColumn(
        "throughput_per_second", F.try_divide(F.lit(float(batch)), F.col("mean_seconds"))
    )


def cost_per_million(latency: DataFrame, rates: DataFrame, on: str, batch: int) -> DataFrame:
    """Cost of a million predictions from mean seconds per batch and a table of prices per second."""
    cost = F.col("mean_seconds") / F.lit(batch) * F.lit(1_000_000) * F.col("rate_per_second")
    return latency.join(rates, on).withColumn("cost_per_million", cost)
