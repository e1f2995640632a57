
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift as dr
from riskloom.plans.drift_report import drift_report

from helpers import ks, plan_of, psi


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def psi_of(spark, a, b, **options):
    return dr.psi(column(spark, a), column(spark, b), numeric=["x"], **options).first()["psi"]


def test_identical_samples(spark):
    values = [1.0, 2.0, 3.0, 4.0] * 50
    assert psi_of(spark, values, values) < 1e-6


def test_shifted_normals_alert(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 1000).tolist(), rng.normal(1.5, 1, 1000).tolist()
    row = dr.feature_drift(column(spark, a), column(spark, b), ["x"], psi_threshold=0.1).first()
    assert row["has_alert"] and len(row["alerts"]) == 2
    assert row["psi"] == pytest.approx(psi(a, b), abs=1e-12)
    assert row["ks_statistic"] == pytest.approx(ks(a, b), abs=1e-12)
    assert row["ks_pvalue"] < 1e-6


@pytest.mark.parametrize(
    "a, b",
    [
        ([1.0, 1.0, 1.0, 2.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]),
        ([5.0] * 10, [4.0] * 10),
        ([5.0] * 10, [5.0] * 7),
        ([1.0, None, float("nan"), 3.0], [2.0, None]),
        ([0.0, -0.0, 1.0], [-0.0, 0.0]),
    ],
)
def test_psi_equals_numpy(spark, a, b):
    assert psi_of(spark, a, b) == pytest.approx(psi(a, b), abs=1e-12)


def test_psi_edge_cases(spark):
    assert psi_of(spark, [None, float("nan")], [1.0]) is None
    assert psi_of(spark, [1.0], [None]) is None
    assert psi_of(spark, [1.0, 2.0], [5.0, 6.0, 7.0], bins=1) == 0.0
    assert psi_of(spark, [5.0] * 10, [4.0] * 10) > 1


def test_categorical_psi(spark):
    a, b = ["u", "u", "v", None], ["u", "w", "w"]
    value = dr.psi(column(spark, a, "string"), column(spark, b, "string"), categorical=["x"]).first()["psi"]
    eps = 1e-6
    p, q = np.array([2, 1, 0]) / (3 + eps), np.array([1, 0, 2]) / (3 + eps)
    assert value == pytest.approx(float(((p - q) * np.log((p + eps) / (q + eps))).sum()), abs=1e-12)


def test_booleans_are_categories(spark):
    report = dr.feature_drift(column(spark, [True, True, False], "boolean"), column(spark, [False, False], "boolean"))
    row = report.first()
    assert row["psi"] > 0 and row["ks_statistic"] is None


def test_ks_with_ties_and_layout(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(size=500), 1).tolist(), np.round(rng.normal(0.2, size=700), 1).tolist()
    values = [
        dr.ks_two_sample(column(spark, a).repartition(n), column(spark, b).repartition(n), ["x"]).first()["ks_statistic"] for n in (1, 4, 40)
    ]
    assert all(v == pytest.approx(ks(a, b), abs=1e-12) for v in values)


def test_ks_skipped_for_constant_or_empty_sides(spark):
    assert dr.ks_two_sample(column(spark, [1.0, 1.0]), column(spark, [1.0]), ["x"]).first()["ks_statistic"] is None
    assert dr.ks_two_sample(column(spark, [1.0, 2.0]), column(spark, [None]), ["x"]).first()["ks_statistic"] is None
    assert dr.ks_two_sample(column(spark, [1.0, 1.0]), column(spark, [1.0, 2.0]), ["x"]).first()["ks_statistic"] == 0.5


def test_p_value_of_known_points(spark):
    # Kolmogorov's limit: lambda 1.36 is the 5 % point.
    n = 1_000_000.0
    d = 1.3581 / np.sqrt(n / 2)
    row = spark.range(1).select(dr.ks_p_value(F.lit(float(d)), F.lit(n), F.lit(n)).alias("p")).first()
    assert row["p"] == pytest.approx(0.05, abs=1e-3)
    assert spark.range(1).select(dr.ks_p_value(F.lit(0.0), F.lit(n), F.lit(n)).alias("p")).first()["p"] == 1.0


def test_shifted_samples_alert_at_every_size(spark):
    rng = np.random.default_rng(12)
    found = []
    for n in (200, 2_000, 5_000, 10_000, 10_001):
        q = (np.arange(n) + 0.5) / n
        a, b = column(spark, q.tolist()), column(spark, (q + 1.2 / np.sqrt(n / 2)).tolist())
        found.append(dr.ks_two_sample(a, b, ["x"]).first()["ks_pvalue"])
    # The same scaled distance gives nearly the same p-value, and nothing jumps at 10,000 rows.
    assert all(0.05 < p < 0.15 for p in found) and found[3] == pytest.approx(found[4], rel=0.02)
    a, b = column(spark, rng.normal(size=5000).tolist()), column(spark, rng.normal(0.3, 1, size=5000).tolist())
    row = dr.feature_drift(a, b, ["x"]).first()
    assert row["ks_pvalue"] < 1e-10 and row["has_alert"]


def test_inputs(spark):
    empty, full = column(spark, []), column(spark, [1.0])
    with pytest.raises(ValueError, match="current"):
        dr.require_inputs(full, empty, ["x"])
    with pytest.raises(KeyError):
        dr.require_inputs(full, full, ["x", "y"])
    assert dr.common_columns(full.withColumn("y", F.lit(1)), full) == ["x"]


def test_performance_drift(spark):
    metrics = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    out = dr.performance_drift(
        metrics([("auc", 0.5), ("f1", 0.5), ("gone", 0.1), ("p", 0.5)]),
        metrics([("auc", 0.75), ("f1", 0.625), ("new", 0.2), ("p", 0.515)]),
        spark.createDataFrame([("auc", 0.25), ("f1", 0.1)], "metric string, tolerance double"),
    ).collect()
    assert [(r["metric"], r["alert"]) for r in out] == [("auc", False), ("f1", True), ("gone", True), ("new", True), ("p", False)]
    assert out[2]["delta"] is None and out[4]["tolerance"] == 0.02


def test_report_header(spark):
    left = spark.createDataFrame([(1.0, "2024-01-01"), (2.0, "2024-01-02")], "x double, event_time string")
    right = spark.createDataFrame([(9.0,), (8.0,)], "x double")
    report = drift_report(left, right, ["x"], current_metrics=spark.createDataFrame([("auc", 0.5)], "metric string, value double"))
    row = report.header.first()
    assert row["reference_rows"] == 2 and row["reference_time_max"] == "2024-01-02" and row["current_time_min"] is None
    assert row["data_alert"] and row["performance_alert"] and row["has_alerts"]


def test_plan_has_no_cross_join(spark):
    rng = np.random.default_rng(1)
    a = column(spark, rng.normal(size=100).tolist())
    plan = plan_of(dr.feature_drift(a, a, ["x"]))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
