"""Risk segments of scored customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import RISK_LABELS, RISK_QUANTILES, right_closed
from ..functions.scalars import percent_format
from .ordered import exact_quantiles


def join_predictions(raw: DataFrame, predictions: DataFrame, key: str = "entity_id", label: str = "label") -> DataFrame:
    """Raw rows with their predictions; the label is taken from the predictions only."""
    return raw.drop(label).join(predictions, key, "inner")


def qcut(
    df: DataFrame, column: str, quantiles: Sequence[float] = RISK_QUANTILES, labels: Sequence[str] = RISK_LABELS, out: str = "segment"
) -> DataFrame:
    """Label rows by exact quantile bands, right-closed, the lowest value included.

    Repeated edges leave a band without extent and are an error.
    """
    edges = exact_quantiles(df, [column], quantiles)[column]
    if edges[0] is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    if len(set(edges)) < len(edges):
        raise ValueError(f"quantile edges of {column} are not unique: {edges}")
    return df.withColumn(out, right_closed(column, edges, labels))


def segment_filter(df: DataFrame, segment: str = "critical", column: str = "segment") -> DataFrame:
    return df.where(F.col(column) == F.lit(segment))


def segment_summary(
    df: DataFrame,
    segment: str = "segment",
    label: str = "label",
    averages: dict[str, str] | None = None,
    shares: dict[str, str] | None = None,
    formatted: bool = False,
) -> DataFrame:
    """Per segment the number of customers, churn rate and means.

    ``averages`` and ``shares`` map output names to columns; rates and shares are shown as percent
    text when ``formatted``.
    """
    rates = {"churn_rate": label, **(shares or {})}
    out = df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.avg(c).alias(name) for name, c in rates.items()],
        *[F.avg(c).alias(name) for name, c in (averages or {}).items()],
    )
    return out.withColumns({name: percent_format(name) for name in rates}) if formatted else out
