"""Profiling: summaries, skew, missing values, correlation, densities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import stage
from . import ordered

ID_COLUMNS = ("entity_id", "dataset", "label")
MAX_CLASS_ROWS = 100_000
# Cells of a density per bandwidth, and bandwidths after which a kernel ends.
CELLS_PER_BANDWIDTH = 32
KERNEL_REACH = 8.0


def split_by_type(df: DataFrame, exclude: Sequence[str] = ID_COLUMNS) -> tuple[list[str], list[str]]:
    """Names of numeric and of other columns, from the schema."""
    kept = [f for f in df.schema.fields if f.name not in exclude]
    numeric = [f.name for f in kept if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in kept if f.name not in numeric]


def _number(column: str) -> Column:
    """The value as double, with NaN as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def sample_skew(value: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant column."""
    n = F.count(value)
    spread = F.when(F.max(value) == F.min(value), F.lit(0.0)).otherwise(F.skewness(value))
    return F.when(n > 2, spread * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def _as_rows(one_row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn ``<field>_<i>`` columns of a single row into one row per column name."""
    entries = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, c in enumerate(columns)
    ]
    return one_row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, max and skew per column in one wide aggregate."""
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        v = _number(c)
        aggs += [
            F.count(v).alias(f"count_{i}"),
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_samp(v).alias(f"std_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
            sample_skew(v).alias(f"skew_{i}"),
        ]
    return _as_rows(df.agg(*aggs), columns, ["count", "mean", "std", "min", "max", "skew"])


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Summary per numeric column: count, mean, std, min, quartiles, max, skew, IQR."""
    columns = list(columns or split_by_type(df, exclude=())[0])
    quartiles = ordered.exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    known = df.sparkSession.createDataFrame(
        [(c, *quartiles[c]) for c in columns], "feature string, p25 double, p50 double, p75 double"
    )
    return (
        moments(df, columns)
        .join(F.broadcast(known), "feature")
        .select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max", "skew", (F.col("p75") - F.col("p25")).alias("iqr"))
    )


def skew_rank(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """The columns of largest absolute skew."""
    columns = list(columns or split_by_type(df, exclude=())[0])
    row = df.agg(*[sample_skew(_number(c)).alias(f"skew_{i}") for i, c in enumerate(columns)])
    return _as_rows(row, columns, ["skew"]).orderBy(F.desc_nulls_last(F.abs("skew")), "feature").limit(top)


def missing_share(df: DataFrame, columns: Sequence[str] | None = None, only_positive: bool = True) -> DataFrame:
    """Share of missing values per column (NaN counts as missing), largest first."""
    columns = list(columns or df.columns)
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    absent = lambda c: (F.col(c).isNull() | F.isnan(c)) if c in floating else F.col(c).isNull()
    row = df.agg(*[F.avg(absent(c).cast("int")).alias(f"share_{i}") for i, c in enumerate(columns)])
    shares = _as_rows(row, columns, ["share"])
    if only_positive:
        shares = shares.where("share > 0")
    return shares.orderBy(F.desc("share"), "feature")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair ``(a, b, r)``, both orders and the diagonal.

    A pair uses the rows where both values are present. One scan: each task multiplies its Arrow batches and hands on
    one row of sums per pair. The means are read before, since sums about them lose no digits. A pair with a constant
    or an infinite value has no correlation.
    """
    columns = list(columns)
    means = df.agg(*[F.avg(_number(c)).alias(f"m_{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([m if m is not None and math.isfinite(m) else 0.0 for m in means])
    size = len(columns)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy", "bad"]
    ends = ["low", "high", "low_b", "high_b"]
    kinds = ", ".join(f"{n} double" for n in [*names, *ends])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), size, size))
        low, high = np.full((size, size), np.inf), np.full((size, size), -np.inf)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - centre
            present, bad = (~np.isnan(x)).astype(np.float64), np.isinf(x)
            z = np.where(bad | np.isnan(x), 0.0, x)
            sx, sxx = z.T @ present, (z * z).T @ present
            infinite = bad.astype(np.float64).T @ present
            total += np.stack([present.T @ present, sx, sx.T, sxx, sxx.T, z.T @ z, infinite + infinite.T])
            for j in range(size):
                held = x[present[:, j] > 0]
                if len(held):
                    low[:, j] = np.fmin(low[:, j], np.fmin.reduce(held, axis=0))
                    high[:, j] = np.fmax(high[:, j], np.fmax.reduce(held, axis=0))
        place = np.indices((size, size)).reshape(2, -1)
        arrays = [*place, *total.reshape(len(names), -1), *[v.reshape(-1) for v in (low, high, low.T, high.T)]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["i", "j", *names, *ends])

    parts = df.select(*[_number(c).alias(f"c_{i}") for i, c in enumerate(columns)]).mapInArrow(sums, f"i long, j long, {kinds}")
    outer = [F.min(e).alias(e) if e.startswith("low") else F.max(e).alias(e) for e in ends]
    pairs = parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names], *outer)
    named = df.sparkSession.createDataFrame(
        [(i, j, a, b) for i, a in enumerate(columns) for j, b in enumerate(columns)], "i long, j long, a string, b string"
    )
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(
        (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    )
    known = (F.col("low") < F.col("high")) & (F.col("low_b") < F.col("high_b")) & (F.col("bad") == 0)
    value = F.when(known, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(r))
    return named.join(pairs, ["i", "j"], "left").select("a", "b", value.alias("r"))


def density_by_class(
    df: DataFrame, columns: Sequence[str], label: str, grid: int = 200, cells: int = CELLS_PER_BANDWIDTH, reach: float = 3.0
) -> DataFrame:
    """Gaussian kernel density per column and class ``(feature, label, position, x, density)``.

    Bandwidth by Scott's rule, the grid runs ``reach`` bandwidths past the data, each class has area 1. Rows are first
    summed in cells, ``cells`` to a bandwidth, and only cells that hold rows are kept. A cell has the sums of the powers
    up to 4 of its rows' distances to its middle, which give the kernels' sum by their Taylor series: what is left out is
    below ``(1 / (2 * cells)) ** 5 / 40`` of a kernel's peak. Kernels end ``KERNEL_REACH`` bandwidths away, at 2e-14 of it.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), _number(c).alias("v")) for c in columns])
    long = df.select(F.col(label).alias("label"), F.explode(entries).alias("e")).select("label", "e.feature", "e.v").where("v is not null")
    stats = long.groupBy("feature", "label").agg(
        F.count("v").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high")
    ).where((F.col("n") > 1) & (F.col("s") > 0) & (F.col("s") < float("inf"))).withColumn("bw", F.col("s") * F.pow("n", F.lit(-0.2)))
    # One row per column and class; checked, as a label column may hold anything.
    stats = stage(stats, "class-stats")
    small = stats.limit(MAX_CLASS_ROWS + 1).count() <= MAX_CLASS_ROWS
    one = F.broadcast(stats) if small else stats
    place = (F.col("v") - F.col("low")) / F.col("bw") * cells
    cell = F.floor(place)
    off = (place - cell - 0.5) / cells
    summed = (
        long.join(one, ["feature", "label"])
        .groupBy("feature", "label", "n", "bw", "low", "high", cell.alias("cell"))
        .agg(F.count("v").cast("double").alias("m0"), *[F.sum(F.pow(off, F.lit(k))).alias(f"m{k}") for k in range(1, 5)])
    )
    start, width = F.col("low") - F.col("bw") * reach, (F.col("high") - F.col("low") + F.col("bw") * (2 * reach)) / (grid - 1)
    middle = F.col("low") + (F.col("cell") + 0.5) / cells * F.col("bw")
    first = F.greatest(F.ceil((middle - F.col("bw") * KERNEL_REACH - start) / width), F.lit(0))
    last = F.least(F.floor((middle + F.col("bw") * KERNEL_REACH - start) / width), F.lit(grid - 1))
    near = summed.withColumns({"middle": middle, "first": first, "last": last}).where("first <= last")
    near = near.withColumn("i", F.explode(F.sequence("first", "last")))
    x = start + width * F.col("i")
    z = (x - F.col("middle")) / F.col("bw")
    # The derivatives of a kernel are its value times the Hermite polynomials.
    hermite = [F.lit(1.0), z, z * z - 1, (z * z - 3) * z, (z * z - 6) * z * z + 3]
    series = sum((F.col(f"m{k}") * h / math.factorial(k) for k, h in enumerate(hermite[1:], 1)), F.col("m0"))
    sums = near.groupBy("feature", "label", "i").agg(F.sum(F.exp(-z * z / 2) * series).alias("k"))
    points = stats.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))))
    met = points.join(sums, (points["feature"] == sums["feature"]) & points["label"].eqNullSafe(sums["label"]) & (points["i"] == sums["i"]), "left")
    density = F.coalesce("k", F.lit(0.0)) / (F.col("n") * F.col("bw") * F.sqrt(2 * F.pi()))
    return met.select(points["feature"], points["label"], points["i"].cast("int").alias("position"), (start + width * points["i"]).alias("x"), density.alias("density"))


def top_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, the most frequent value (the smallest of equals) and its count."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = (
        df.select(F.explode(entries).alias("e")).select("e.feature", "e.v").where("v is not null")
        .groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("feature").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"),
        F.max("n").alias("freq"),
    )


def profile_any(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Summary of numeric and other columns in one table; what does not apply is null."""
    columns = list(columns or df.columns)
    numeric, other = split_by_type(df.select(*columns), exclude=())
    parts = []
    if numeric:
        parts.append(profile_numeric(df, numeric).drop("skew", "iqr"))
    if other:
        parts.append(top_values(df, other))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def profile_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored profile for range checks: ``(feature, min, max)``."""
    row = df.agg(*[f(_number(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("min", F.min), ("max", F.max))])
    return _as_rows(row, columns, ["min", "max"])
