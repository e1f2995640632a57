"""Drift report: features, metrics, metadata and overall flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import drift


@dataclass
class DriftReport:
    header: DataFrame
    features: DataFrame
    metrics: DataFrame | None


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    psi_threshold: float = drift.PSI_THRESHOLD,
    p_threshold: float = drift.P_VALUE_THRESHOLD,
    baseline_metrics: DataFrame | None = None,
    current_metrics: DataFrame | None = None,
    tolerances: DataFrame | None = None,
    time_column: str = "event_time",
) -> DriftReport:
    """All features in one pass each for PSI and KS, metric drift, and one header row.

    A missing metrics table counts as empty when the other one is given.
    """
    by_feature = drift.feature_drift(reference, current, features, psi_threshold, p_threshold)
    metrics = None
    if baseline_metrics is not None or current_metrics is not None:
        none = reference.sparkSession.createDataFrame([], "metric string, value double")
        metrics = drift.performance_drift(
            baseline_metrics if baseline_metrics is not None else none,
            current_metrics if current_metrics is not None else none,
            tolerances,
        )
    header = report_header(reference, current, by_feature, metrics, psi_threshold, p_threshold, time_column)
    return DriftReport(header, by_feature, metrics)


def report_header(
    reference: DataFrame,
    current: DataFrame,
    by_feature: DataFrame,
    metrics: DataFrame | None,
    psi_threshold: float,
    p_threshold: float,
    time_column: str,
) -> DataFrame:
    """One row: when, how many rows and which time range per side, thresholds and flags."""
    sides = drift.side_metadata(reference, current, time_column)
    pick = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    data_alert = by_feature.agg(F.coalesce(F.bool_or("has_alert"), F.lit(False))).scalar()
    metric_alert = metrics.agg(F.coalesce(F.bool_or("alert"), F.lit(False))).scalar() if metrics is not None else F.lit(False)
    return (
        sides.agg(
            *[
                pick(side, column).alias(f"{side}_{column}")
                for side in ("reference", "current")
                for column in ("rows", "time_min", "time_max")
            ]
        )
        .withColumns({"data_alert": data_alert, "performance_alert": metric_alert})
        .withColumns(
            {
                "generated_at": F.current_timestamp(),
                "psi_threshold": F.lit(float(psi_threshold)),
                "ks_pvalue_threshold": F.lit(float(p_threshold)),
                "has_alerts": F.col("data_alert") | F.col("performance_alert"),
            }
        )
    )
