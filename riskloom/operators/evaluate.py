"""Evaluation of scores against labels: curves, areas, thresholds, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.bands import edges_at_or_below, edges_below
from ..session import stage
from . import ordered


def linspace(start: float, stop: float, n: int) -> list[float]:
    """``n`` evenly spaced numbers, both ends included."""
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [float(stop)]


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient that is 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


@dataclass
class ScoreCounts:
    """``counts``: per distinct score ``(bucket, value, pos, neg)``; totals known to the driver."""

    counts: DataFrame
    positives: int
    negatives: int
    cuts: list[float]

    def running(self, descending: bool) -> DataFrame:
        sums = {"pos": F.sum("pos"), "neg": F.sum("neg")}
        return ordered.running_sums(self.counts, sums, descending=descending)


def score_counts(df: DataFrame, score: str = "probability", label: str = "label", keep: bool = False) -> ScoreCounts:
    """Collapse a score table to its distinct scores. ``keep`` stages the result for several readers.

    Like any evaluation, it refuses missing scores or labels. The check shares the pass that finds
    the cut points.
    """
    rows = df.select(F.col(score).cast("double").alias("value"), F.col(label).cast("int").alias("label"))
    bad = F.col("value").isNull() | F.isnan("value") | F.col("label").isNull()
    found, head = ordered.cut_points_and_counts(
        rows, ["value"], {"bad": F.count_if(bad), "pos": F.count_if(F.col("label") == 1), "n": F.count(F.lit(1))}
    )
    if head["bad"]:
        raise ValueError(f"{head['bad']} rows have no score or no label")
    cuts = found["value"]
    bucketed = ordered.with_buckets(rows, {"value": cuts})
    counts = (
        bucketed.groupBy(F.col("__bucket_0").alias("bucket"), F.col("__value_0").alias("value"))
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    )
    if keep:
        counts = stage(counts, "score-counts")
    return ScoreCounts(counts, head["pos"], head["n"] - head["pos"], cuts)


def precision_recall_curve(table: ScoreCounts) -> DataFrame:
    """``(threshold, precision, recall)``, one row per distinct score, and the end point (null, 1, 0)."""
    total = table.positives
    run = table.running(descending=True)
    recall = F.col("run_pos") / F.lit(float(total)) if total else F.lit(1.0)
    points = run.select(
        F.col("value").alias("threshold"),
        (F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))).alias("precision"),
        recall.alias("recall"),
    )
    end = run.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def ranking_metrics(table: ScoreCounts) -> DataFrame:
    """One row ``(roc_auc, average_precision)``; the area is null when one class is absent."""
    p, n = float(table.positives), float(table.negatives)
    run = table.running(descending=True)
    # Seen from the top: negatives below a score are all negatives less those at or above it.
    below = F.lit(n) - F.col("run_neg")
    auc = F.sum(F.col("pos") * (below + F.col("neg") / 2)) / F.lit(p * n) if p and n else F.lit(None).cast("double")
    step = F.col("pos") / F.lit(p) * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg")) if p else F.lit(0.0)
    return run.agg(auc.alias("roc_auc"), F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def roc_auc(table: ScoreCounts) -> DataFrame:
    return ranking_metrics(table).select("roc_auc")


def average_precision(table: ScoreCounts) -> DataFrame:
    return ranking_metrics(table).select("average_precision")


def confusion_metrics(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: counts, precision, recall and F1 of ``score >= threshold``."""
    hit, true = F.col(score) >= F.lit(float(threshold)), F.col(label) == 1
    counts = df.agg(
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
        F.count_if(~hit & ~true).alias("tn"),
    )
    scored = counts.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    return scored.select(
        F.lit(float(threshold)).alias("threshold"), "tp", "fp", "fn", "tn", "precision", "recall",
        f1(F.col("precision"), F.col("recall")).alias("f1"),
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted averages."""
    matrix = df.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).count()
    # From here on one row per class: the confusion matrix is as small as the label set squared.
    sides = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("t").cast("string").alias("class"), F.col("count").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("p").cast("string").alias("class"), F.lit(0).cast("long").alias("support"), F.col("count").alias("predicted")),
            )
        ).alias("s"),
        F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(F.lit(0)).alias("hits"),
    )
    classes = (
        sides.groupBy(F.col("s.class").alias("class"))
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
            (F.sum("hits") / 2).cast("long").alias("tp"),
        )
        .withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
    )
    shown = ["class", "precision", "recall", "f1", "support"]
    totals = classes.agg(
        F.sum("support").alias("n"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )
    summary = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(c) for c in shown[1:4]], F.col("n").alias("support")),
                *[
                    F.struct(
                        F.lit(f"{kind} avg").alias("class"),
                        *[F.col(f"{kind}_{c}").alias(c) for c in shown[1:4]],
                        F.col("n").alias("support"),
                    )
                    for kind in ("macro", "weighted")
                ],
            )
        ).alias("r")
    ).select("r.*")
    return classes.select(*shown).unionByName(summary)


def threshold_sweep(table: ScoreCounts, thresholds: Sequence[float], extra: Sequence[float] | None = None) -> DataFrame:
    """Precision, recall, F1 per threshold, and the average precision of the whole table.

    Rows fall once into the band between two thresholds; running sums over those few bands give
    every threshold, so the table is never multiplied by the number of thresholds.
    """
    edges = sorted(set(thresholds))
    spark = table.counts.sparkSession
    bands = (
        table.counts.select(edges_at_or_below("value", edges).alias("band"), "pos", "neg")
        .groupBy("band")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    steps = spark.createDataFrame(
        [
            (i, float(t), float(extra[i]) if extra is not None else None)
            for i, t in enumerate(thresholds)
        ],
        "position int, threshold double, extra double",
    )
    # At most len(thresholds) + 1 bands; each counts towards the thresholds at or below it.
    first_bands = F.array(*[F.lit(edges.index(t) + 1) for t in thresholds])
    reached = F.transform(first_bands, lambda first, i: F.when(first <= F.col("band"), i))
    sums = (
        bands.select(F.explode(F.array_compact(reached)).alias("position"), "pos", "neg")
        .groupBy("position")
        .agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    )
    ap = average_precision(table).scalar()
    out = (
        steps.join(F.broadcast(sums), "position", "left")
        .fillna(0, ["tp", "fp"])
        .withColumns(
            {
                "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
                "recall": ratio(F.col("tp"), F.lit(table.positives)),
            }
        )
        .withColumns({"f1": f1(F.col("precision"), F.col("recall")), "average_precision": ap})
    )
    columns = ["position", "threshold", "precision", "recall", "f1", "average_precision"]
    return out.select(*columns, F.col("extra").alias("percentile")) if extra is not None else out.select(*columns)


def score_thresholds(steps: int = 15) -> list[float]:
    """Evenly spaced probability thresholds."""
    return linspace(0.05, 0.95, steps)


def percentile_thresholds(table: ScoreCounts, steps: int = 15) -> tuple[list[float], list[float]]:
    """Percentiles 60 to 99.9 of the scores, for scores without a fixed range."""
    percentiles = linspace(60.0, 99.9, steps)
    return percentiles, counted_quantiles(table, [p / 100 for p in percentiles])


def counted_quantiles(table: ScoreCounts, probs: Sequence[float]) -> list[float]:
    weighted = table.counts.withColumn("n", F.col("pos") + F.col("neg"))
    return ordered.exact_quantiles(weighted, ["value"], probs, weight="n", cuts={"value": table.cuts})["value"]


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first row with the highest F1."""
    return sweep.orderBy(F.desc("f1"), F.asc("position")).limit(1)


def calibration_curve(table: ScoreCounts, bins: int = 10, scale: tuple[float, float] | None = None) -> DataFrame:
    """Mean score and share of positives per quantile bin ``(bin, n, mean_score, positive_rate)``.

    ``scale`` = (min, max) maps the scores to [0, 1] first, as is done for anomaly scores.
    """
    edges = counted_quantiles(table, linspace(0.0, 1.0, bins + 1))
    value = F.col("value")
    shown = (value - F.lit(scale[0])) / F.lit(scale[1] - scale[0] + 1e-12) if scale else value
    n = F.col("pos") + F.col("neg")
    return (
        table.counts.select(edges_below("value", edges[1:-1]).alias("bin"), "pos", n.alias("n"), (shown * n).alias("total"))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_score"), (F.sum("pos") / F.sum("n")).alias("positive_rate"))
    )


def score_percentile(df: DataFrame, score: str, percentiles: Sequence[float]) -> dict[float, float | None]:
    """Exact linear percentiles (0 to 100) of a score column."""
    values = ordered.exact_quantiles(df, [score], [p / 100 for p in percentiles])[score]
    return dict(zip(percentiles, values))


def group_rates(df: DataFrame, group: str, label: str, prediction: str) -> DataFrame:
    """Per group the selection rate and true positive rate, with the gaps between the groups."""
    hit, true = F.col(prediction) == 1, F.col(label) == 1
    rates = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit.cast("int")).alias("selection_rate"),
        F.try_divide(F.count_if(hit & true), F.count_if(true)).alias("true_positive_rate"),
    )
    gaps = rates.agg(
        F.struct(
            (F.max("selection_rate") - F.min("selection_rate")).alias("s"),
            (F.max("true_positive_rate") - F.min("true_positive_rate")).alias("t"),
        )
    ).scalar()
    return rates.withColumns({"selection_rate_gap": gaps.getField("s"), "true_positive_rate_gap": gaps.getField("t")})
