"""Validation of the feature store and of raw tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .balance import duplicate_count

# The data sets a store may hold, and its labels.
DATASETS = ("fraud", "churn")
LABELS = (0, 1)
# A report line spells out no more values than this; `unexpected_values` always has them all.
LISTED_VALUES = 20


class ValidationError(ValueError):
    """Raised when a check fails."""


def unexpected_values(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Distinct values outside the allowed set, sorted; a missing value is unexpected."""
    bad = ~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    return df.where(bad).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first(column))


def _listing(df: DataFrame, column: str, allowed: Sequence, quote: bool) -> DataFrame:
    """One row: how many distinct unexpected values there are, and the first of them as text."""
    bad = unexpected_values(df, column, allowed).select(column)
    shown = F.col(column).cast("string")
    text = F.coalesce(F.concat(F.lit("'"), shown, F.lit("'")) if quote else shown, F.lit("None"))
    first = bad.limit(LISTED_VALUES).agg(F.array_sort(F.collect_list(F.struct(F.col(column), text.alias("t")))).alias("v"))
    count = bad.agg(F.count(F.lit(1))).scalar()
    names = F.concat_ws(", ", F.transform("v", lambda x: x["t"]))
    more = F.when(F.col("k") > LISTED_VALUES, F.concat(F.lit(", ... "), (F.col("k") - LISTED_VALUES).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return first.withColumn("k", count).select("k", F.concat(F.lit("["), names, more, F.lit("]")).alias("listing"))


def stray_values(df: DataFrame, datasets: Sequence[str] = DATASETS, labels: Sequence[int] = LABELS) -> DataFrame:
    """Every unexpected value of the store's checks ``(check, value, n)``, of which the report's lines show the first."""
    parts = [
        unexpected_values(df, column, allowed).select(F.lit(f"{column}_values_valid").alias("check"), F.col(column).cast("string").alias("value"), "n")
        for column, allowed in (("dataset", datasets), ("label", labels))
    ]
    return parts[0].unionByName(parts[1])


def validate_feature_store(df: DataFrame, datasets: Sequence[str] = DATASETS, labels: Sequence[int] = LABELS) -> DataFrame:
    """The seven checks of a feature store as rows ``(position, name, success, details)``.

    One pass counts rows and missing fields per data set and label; all checks but one read that
    small staged table. Duplicate keys need a grouping of their own. Both combine map-side.
    """
    nulls = [("entity_id_not_null", "entity_id"), ("features_not_null", "features"), ("label_not_null", "label")]
    groups = stage(
        df.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for _, c in nulls]),
        "store-groups",
    )
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    counts = groups.agg(F.struct(total("rows").alias("rows"), *[total(f"no_{c}").alias(c) for _, c in nulls]).alias("c"))
    base = df.sparkSession.range(1).select(
        counts.scalar().alias("c"),
        _listing(groups, "dataset", datasets, quote=True).select(F.struct("k", "listing")).scalar().alias("d"),
        _listing(groups, "label", labels, quote=False).select(F.struct("k", "listing")).scalar().alias("l"),
        duplicate_count(df, ["entity_id", "dataset"]).scalar().alias("dup"),
    )

    def line(position: int, name: str, success: Column, details: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("name"), success.alias("success"), details.alias("details")
        )

    def none_null(position: int, name: str, column: str) -> Column:
        n = F.col(f"c.{column}")
        return line(position, name, n == 0, F.concat(F.lit("null_count="), n.cast("string")))

    def no_strays(position: int, name: str, source: str, prefix: str) -> Column:
        k = F.col(f"{source}.k")
        return line(position, name, k == 0, F.when(k > 0, F.concat(F.lit(prefix), F.col(f"{source}.listing"))))

    lines = F.array(
        line(1, "row_count_positive", F.col("c.rows") > 0, F.concat(F.lit("row_count="), F.col("c.rows").cast("string"))),
        none_null(2, *nulls[0]),
        no_strays(3, "dataset_values_valid", "d", "unexpected="),
        none_null(4, *nulls[1]),
        none_null(5, *nulls[2]),
        no_strays(6, "label_values_valid", "l", "unexpected_labels="),
        line(7, "entity_dataset_unique", F.col("dup") == 0, F.concat(F.lit("duplicate_count="), F.col("dup").cast("string"))),
    )
    return base.select(F.explode(lines).alias("r")).select("r.*")


def overall(report: DataFrame) -> DataFrame:
    """One row: whether every check passed."""
    return report.agg(F.coalesce(F.bool_and("success"), F.lit(True)).alias("success"))


def require_valid(report: DataFrame) -> list:
    """Raise when a check failed; call it after the report is written. Returns the report's rows."""
    rows = report.collect()
    failed = [r["name"] for r in rows if not r["success"]]
    if failed:
        raise ValidationError(f"validation failed: {', '.join(failed)}")
    return rows


@dataclass(frozen=True)
class Rule:
    """A check on one column of a raw table.

    ``kind`` is ``not_null``, ``non_negative``, ``in_set`` (with ``values``), ``in_range`` (with
    ``low`` and ``high``, say from a stored profile) or ``unique``.
    """

    name: str
    kind: str
    column: str
    values: tuple = field(default=())
    low: float | None = None
    high: float | None = None

    def violation(self) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "non_negative":
            return c < 0
        if self.kind == "in_set":
            return ~F.coalesce(c.isin(list(self.values)), F.lit(False))
        if self.kind == "in_range":
            return (c < F.lit(self.low)) | (c > F.lit(self.high))
        raise ValueError(f"no row check for rule kind {self.kind}")


def range_rules(profile: DataFrame) -> list[Rule]:
    """Range rules from a stored profile ``(feature, min, max)``, one row per column."""
    return [Rule(f"{r['feature']}_in_range", "in_range", r["feature"], low=r["min"], high=r["max"]) for r in profile.collect()]


def validate_raw(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations per rule ``(name, violations, success)``; all row checks share one pass."""
    by_row = [r for r in rules if r.kind != "unique"]
    out = None
    if by_row:
        row = df.agg(*[F.count_if(r.violation()).alias(f"v_{i}") for i, r in enumerate(by_row)])
        entries = [F.struct(F.lit(r.name).alias("name"), F.col(f"v_{i}").alias("violations")) for i, r in enumerate(by_row)]
        out = row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
    for rule in rules:
        if rule.kind == "unique":
            part = duplicate_count(df, [rule.column]).select(F.lit(rule.name).alias("name"), F.col("duplicates").alias("violations"))
            out = part if out is None else out.unionByName(part)
    return out.withColumn("success", F.col("violations") == 0)
