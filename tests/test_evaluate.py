import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as ev
from riskloom.plans.evaluation import evaluate_scores

from helpers import auc, average_precision, curve, plan_of


def frame(spark, scores, labels):
    return spark.createDataFrame(list(zip(map(float, scores), map(int, labels))), "probability double, label int")


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 2000)
    scores = np.round(np.clip(rng.normal(0.4 + 0.2 * labels, 0.2), 0, 1), 2)
    return scores, labels, frame(spark, scores, labels)


def test_curve_and_areas(scored):
    scores, labels, df = scored
    table = ev.score_counts(df)
    points = sorted((r["threshold"], r["precision"], r["recall"]) for r in ev.precision_recall_curve(table).collect() if r["threshold"] is not None)
    np.testing.assert_allclose(points, curve(scores, labels), atol=1e-12)
    row = ev.ranking_metrics(table).first()
    assert row["roc_auc"] == pytest.approx(auc(scores, labels), abs=1e-12)
    assert row["average_precision"] == pytest.approx(average_precision(scores, labels), abs=1e-12)


def test_step_sum_not_interpolated(spark):
    df = frame(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])
    row = ev.ranking_metrics(ev.score_counts(df)).first()
    assert row["average_precision"] == pytest.approx(0.8333333333)
    assert row["roc_auc"] == pytest.approx(0.75)


def test_layout_does_not_matter(scored):
    _, _, df = scored
    rows = [ev.ranking_metrics(ev.score_counts(df.repartition(n))).first() for n in (1, 4, 60)]
    assert rows[0]["roc_auc"] == pytest.approx(rows[2]["roc_auc"], abs=1e-14) and rows[1]["average_precision"] == pytest.approx(rows[2]["average_precision"], abs=1e-14)


def test_one_class_and_equal_scores(spark):
    only_negative = ev.ranking_metrics(ev.score_counts(frame(spark, [0.1, 0.9], [0, 0]))).first()
    assert only_negative["roc_auc"] is None and only_negative["average_precision"] == 0.0
    equal = ev.ranking_metrics(ev.score_counts(frame(spark, [0.5] * 4, [0, 1, 1, 0]))).first()
    assert equal["roc_auc"] == 0.5 and equal["average_precision"] == 0.5
    assert ev.confusion_metrics(frame(spark, [0.1], [0]), "probability", "label", 0.5).first()["f1"] == 0.0


def test_missing_scores_are_refused(spark):
    df = spark.createDataFrame([(0.5, 1), (None, 0), (float("nan"), 0)], "probability double, label int")
    with pytest.raises(ValueError, match="2 rows"):
        ev.score_counts(df)


def test_sweep_and_best(scored):
    scores, labels, df = scored
    report = evaluate_scores(df)
    for r in report.sweep.collect():
        hit = scores >= r["threshold"]
        tp = int(labels[hit].sum())
        precision = tp / hit.sum() if hit.sum() else 0.0
        assert r["precision"] == pytest.approx(precision) and r["recall"] == pytest.approx(tp / labels.sum())
    rows = sorted(report.sweep.collect(), key=lambda r: r["position"])
    assert len(rows) == 15 and rows[0]["threshold"] == 0.05 and rows[-1]["threshold"] == 0.95
    best = report.best.first()
    assert best["f1"] == max(r["f1"] for r in rows)
    assert best["position"] == min(r["position"] for r in rows if r["f1"] == best["f1"])


def test_threshold_above_all_scores(spark):
    sweep = ev.threshold_sweep(ev.score_counts(frame(spark, [0.1, 0.2], [0, 1])), [0.15, 0.9, 0.9]).collect()
    by_position = {r["position"]: r for r in sweep}
    assert by_position[0]["f1"] == 1.0 and by_position[1]["f1"] == by_position[2]["f1"] == 0.0


def test_anomaly_sweep_uses_percentiles(scored):
    scores, _, df = scored
    rows = sorted(evaluate_scores(df, anomaly=True).sweep.collect(), key=lambda r: r["position"])
    np.testing.assert_allclose([r["threshold"] for r in rows], np.percentile(scores, np.linspace(60, 99.9, 15)), atol=1e-9)


def test_calibration(scored):
    scores, labels, df = scored
    edges = np.percentile(scores, np.linspace(0, 1, 11) * 100)
    bins = np.searchsorted(edges[1:-1], scores)
    rows = {r["bin"]: r for r in ev.calibration_curve(ev.score_counts(df)).collect()}
    assert set(rows) == set(bins)
    for b, r in rows.items():
        assert r["mean_score"] == pytest.approx(scores[bins == b].mean()) and r["positive_rate"] == pytest.approx(labels[bins == b].mean())


def test_classification_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "label int, prediction int")
    rows = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert rows["0"]["precision"] == 0.5 and rows["0"]["support"] == 2
    assert rows["1"]["recall"] == pytest.approx(2 / 3)
    assert rows["accuracy"]["f1"] == 0.6 and rows["macro avg"]["support"] == 5
    assert rows["weighted avg"]["recall"] == pytest.approx(0.6)


def test_group_rates(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 0), ("b", 0, 0), ("c", 0, 1)], "g string, label int, prediction int")
    rows = {r["g"]: r for r in ev.group_rates(df, "g", "label", "prediction").collect()}
    assert rows["a"]["selection_rate"] == 0.5 and rows["b"]["true_positive_rate"] == 0.0 and rows["c"]["true_positive_rate"] is None
    assert rows["a"]["selection_rate_gap"] == 1.0 and rows["a"]["true_positive_rate_gap"] == 1.0


def test_no_single_partition_over_rows(scored):
    _, _, df = scored
    plan = plan_of(ev.precision_recall_curve(ev.score_counts(df)), "simple")
    # Only the bucket totals may meet in one partition, below a broadcast.
    assert plan.count("SinglePartition") <= 1 and "BroadcastHashJoin" in plan and "Cartesian" not in plan
    assert F.col is not None
