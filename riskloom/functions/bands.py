"""Banding of numbers by fixed edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Edges and names of the customer bands.
CREDIT_EDGES = [550, 650, 750]
CREDIT_LABELS = ["poor", "fair", "good", "excellent"]
TENURE_EDGES = [3, 7]
TENURE_LABELS = ["short", "medium", "long"]
# Quantiles and names of the risk segments.
RISK_QUANTILES = [0.0, 0.4, 0.7, 0.9, 1.0]
RISK_LABELS = ["low", "medium", "high", "critical"]


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def band(value: Column | str, edges: Sequence[float], labels: Sequence[str], null_label: str | None = None) -> Column:
    """Left-closed bands: the first label below ``edges[0]``, the last from ``edges[-1]`` on.

    A missing value gets ``null_label``.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    value = _column(value)
    expr = F.when(value.isNull(), F.lit(null_label))
    for edge, label in zip(edges, labels):
        expr = expr.when(value < F.lit(edge), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def credit_band(value: Column | str) -> Column:
    """Credit score band; a missing score counts as the lowest band."""
    return band(value, CREDIT_EDGES, CREDIT_LABELS, null_label=CREDIT_LABELS[0])


def tenure_band(value: Column | str) -> Column:
    """Tenure band; a missing tenure counts as the longest band."""
    return band(value, TENURE_EDGES, TENURE_LABELS, null_label=TENURE_LABELS[-1])


def cut(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """As :func:`band`, but missing values and NaN stay missing."""
    number = _column(value).cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), band(number, edges, labels))


def right_closed(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bands ``[e0,e1], (e1,e2], ...``; outside ``[e0,en]`` and missing give null."""
    number = _column(value).cast("double")
    expr = F.when(number.isNull() | F.isnan(number) | (number < F.lit(float(edges[0]))), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        expr = expr.when(number <= F.lit(float(edge)), F.lit(label))
    return expr


def edges_at_or_below(value: Column | str, edges: Sequence[float]) -> Column:
    """Number of (sorted, few) edges ``<= value``: the index of a left-closed bin."""
    value = _column(value)
    return reduce(lambda a, b: a + b, [(F.lit(float(e)) <= value).cast("int") for e in edges], F.lit(0))


def edges_below(value: Column | str, edges: Sequence[float]) -> Column:
    """Number of (sorted, few) edges ``< value``: the index of a right-closed bin."""
    value = _column(value)
    return reduce(lambda a, b: a + b, [(F.lit(float(e)) < value).cast("int") for e in edges], F.lit(0))
