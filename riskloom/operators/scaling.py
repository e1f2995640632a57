"""Scaling and noise for numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import hash_fraction


def _stats(df: DataFrame, columns: Sequence[str], **functions) -> Column:
    """One struct of whole-table statistics, used as a scalar."""
    fields = [f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in functions.items()]
    return df.agg(F.struct(*fields).alias("stats")).scalar()


def min_max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """``(x - min) / (max - min + 1e-12)``."""
    stats = _stats(df, columns, low=F.min, high=F.max)
    scaled = {
        f"{c}{suffix}": (F.col(c) - stats.getField(f"low_{i}"))
        / (stats.getField(f"high_{i}") - stats.getField(f"low_{i}") + F.lit(1e-12))
        for i, c in enumerate(columns)
    }
    return df.withColumns(scaled)


def fit_standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column ``(feature, mean, scale)``; a zero deviation becomes 1."""
    row = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    )
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"m_{i}").alias("mean"),
            F.when(F.col(f"s_{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{i}")).alias("scale"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def apply_standard_scale(df: DataFrame, scaler: DataFrame, suffix: str = "") -> DataFrame:
    """Scale with a fitted table: one row per feature, so its numbers enter the plan as constants."""
    fitted = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def standard_scale(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None, suffix: str = "") -> DataFrame:
    """Fit on the rows where ``fit_on`` holds (all if none) and scale the whole table."""
    base = df.where(fit_on) if fit_on is not None else df
    return apply_standard_scale(df, fit_standard_scale(base, columns), suffix)


def perturb_numeric(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], strength: float, seed: int = 42, method: str = "xxhash64"
) -> DataFrame:
    """Add normal noise of ``strength`` population deviations, the same for a row wherever it lies.

    Noise comes from two hashes of the row key (Box-Muller). A constant column gets deviation 1,
    no strength changes nothing, missing values stay missing.
    """
    if strength <= 0:
        return df
    stats = _stats(df, columns, s=F.stddev_pop)
    noisy = {}
    for i, c in enumerate(columns):
        u = 1 - hash_fraction(keys, seed * 1_000_003 + 2 * i, method)
        v = hash_fraction(keys, seed * 1_000_003 + 2 * i + 1, method)
        normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
        s = stats.getField(f"s_{i}")
        scale = F.when(F.coalesce(s, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(s)
        noisy[c] = F.col(c) + normal * scale * F.lit(float(strength))
    return df.withColumns(noisy)
