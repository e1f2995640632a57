"""Full evaluation of a score table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate as ev
from ..sources.sinks import write_csv_table, write_json_report


@dataclass
class Evaluation:
    """Tables of an evaluation; all of them come from one staged count per distinct score."""

    ranking: DataFrame
    sweep: DataFrame
    best: DataFrame
    calibration: DataFrame
    curve: DataFrame


def evaluate_scores(
    df: DataFrame, score: str = "probability", label: str = "label", anomaly: bool = False, steps: int = 15, bins: int = 10
) -> Evaluation:
    """Area, average precision, threshold sweep, best threshold, calibration and curve.

    Anomaly scores have no fixed range: their thresholds are percentiles and they are scaled to
    [0, 1] for the calibration.
    """
    table = ev.score_counts(df, score, label, keep=True)
    scale = None
    if anomaly:
        percentiles, thresholds = ev.percentile_thresholds(table, steps)
        sweep = ev.threshold_sweep(table, thresholds, extra=percentiles)
        low, high = ev.counted_quantiles(table, [0.0, 1.0])
        scale = (low, high)
    else:
        sweep = ev.threshold_sweep(table, ev.score_thresholds(steps))
    return Evaluation(
        ranking=ev.ranking_metrics(table),
        sweep=sweep,
        best=ev.best_threshold(sweep),
        calibration=ev.calibration_curve(table, bins, scale),
        curve=ev.precision_recall_curve(table),
    )


def write_evaluation(evaluation: Evaluation, path: str) -> None:
    """Sweep, calibration and curve as CSV tables, and a JSON summary with the areas and the best threshold."""
    write_csv_table(evaluation.sweep.orderBy("position"), f"{path}/threshold_metrics")
    write_csv_table(evaluation.calibration.orderBy("bin"), f"{path}/calibration")
    write_csv_table(evaluation.curve, f"{path}/precision_recall")
    best = evaluation.best.select(F.struct("threshold", "precision", "recall", "f1", "average_precision").alias("best_threshold"))
    write_json_report(evaluation.ranking.withColumn("best_threshold", best.scalar()), f"{path}/summary")
