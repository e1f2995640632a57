import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import balance as ba
from riskloom.operators import profile as pr
from riskloom.operators import segment as sg

from helpers import plan_of


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"a": rng.normal(size=400), "b": rng.exponential(size=400), "c": rng.integers(0, 5, 400).astype(float), "s": rng.choice(list("xyz"), 400)})
    frame.loc[::7, "a"] = np.nan
    frame.loc[::5, "s"] = None
    frame["label"] = rng.integers(0, 2, 400)
    return frame


@pytest.fixture(scope="module")
def df(spark, pdf):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, s string, label int").withColumn(
        # Some of the missing values are NaN.
        "a", F.when(F.col("a").isNull() & (F.col("c") > 2), F.lit(float("nan"))).otherwise(F.col("a"))
    )


def test_profile_numeric(df, pdf):
    expected = pdf[["a", "b", "c"]].describe().T
    for r in pr.profile_numeric(df, ["a", "b", "c"]).collect():
        e = expected.loc[r["feature"]]
        got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        np.testing.assert_allclose(got, e.to_numpy(), atol=1e-10)
        assert r["skew"] == pytest.approx(pdf[r["feature"]].skew()) and r["iqr"] == pytest.approx(e["75%"] - e["25%"])


def test_skew_rank(df, pdf):
    rows = pr.skew_rank(df, ["a", "b", "c"], top=2).collect()
    expected = pdf[["a", "b", "c"]].skew().sort_values(key=lambda s: s.abs(), ascending=False).head(2)
    assert [r["feature"] for r in rows] == list(expected.index)


def test_skew_of_constants_and_few_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, None)], "a double, b double")
    rows = {r["feature"]: r["skew"] for r in pr.skew_rank(df).collect()}
    assert rows == {"a": 0.0, "b": None}


def test_missing_share(df, pdf):
    rows = {r["feature"]: r["share"] for r in pr.missing_share(df).collect()}
    assert rows == {"a": pytest.approx(pdf["a"].isna().mean()), "s": pytest.approx(pdf["s"].isna().mean())}
    assert pr.missing_share(df, only_positive=False).count() == 5


def test_correlation(df, pdf):
    expected = pdf[["a", "b", "c"]].corr()
    rows = pr.correlation_matrix(df, ["a", "b", "c"]).collect()
    assert len(rows) == 9
    for r in rows:
        assert r["r"] == pytest.approx(expected.loc[r["a"], r["b"]])


def test_correlation_of_many_gapped_constant_and_infinite_columns(spark):
    rng = np.random.default_rng(4)
    table = pd.DataFrame(rng.normal(1e6, 1.0, (300, 30)), columns=[f"c{k}" for k in range(30)])
    table.loc[rng.random(300) < 0.3, "c3"] = np.nan
    table["c4"], table["c5"] = 0.1, table["c6"].where(table["c3"].isna(), 7.5)
    df = spark.createDataFrame(table).withColumn("inf", F.when(F.col("c3") > 1e6, float("inf")).otherwise(F.col("c0")))
    out = pr.correlation_matrix(df, [*table.columns, "inf"])
    assert sum("MapInArrow (" in line for line in plan_of(out).split("\n\n")[0].splitlines()) == 1
    expected = table.corr()
    for r in out.where("a != 'inf' AND b != 'inf'").collect():
        want = expected.loc[r["a"], r["b"]]
        assert r["r"] is None if np.isnan(want) or {r["a"], r["b"]} == {"c3", "c5"} else r["r"] == pytest.approx(want, abs=1e-9)
    assert out.where("a = 'inf' AND r IS NOT NULL").where("b != 'inf'").count() == 0
    assert pr.correlation_matrix(df.limit(0), ["c0", "c1"]).where("r IS NULL").count() == 4


def test_profile_any(df, pdf):
    rows = {r["feature"]: r for r in pr.profile_any(df, ["a", "s"]).collect()}
    counts = pdf["s"].value_counts()
    assert rows["s"]["count"] == pdf["s"].notna().sum() and rows["s"]["unique"] == 3
    assert rows["s"]["freq"] == counts.max() and rows["s"]["top"] == min(counts[counts == counts.max()].index)
    assert rows["a"]["top"] is None and rows["s"]["mean"] is None


def test_density_is_close_to_the_exact_kernel_sum(df, pdf):
    rows = pr.density_by_class(df, ["b"], "label", grid=40).collect()
    for label in (0, 1):
        v = pdf.loc[pdf["label"] == label, "b"].to_numpy()
        bw = v.std(ddof=1) * len(v) ** -0.2
        mine = sorted((r["x"], r["density"]) for r in rows if r["label"] == label)
        xs = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 40)
        exact = np.exp(-((xs[:, None] - v) ** 2) / (2 * bw**2)).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))
        np.testing.assert_allclose([m[0] for m in mine], xs, atol=1e-9)
        np.testing.assert_allclose([m[1] for m in mine], exact, atol=1e-10)


@pytest.mark.parametrize("n", [10_000, 1_000_000])
def test_density_of_lognormal_values(spark, tmp_path, n):
    v = np.random.default_rng(n).lognormal(0, 1.5, n)
    pd.DataFrame({"label": np.zeros(n, int), "v": v}).to_parquet(tmp_path / "v.parquet")
    rows = pr.density_by_class(spark.read.parquet(str(tmp_path / "v.parquet")).repartition(4), ["v"], "label", grid=60).collect()
    mine = sorted((r["x"], r["density"]) for r in rows)
    bw = v.std(ddof=1) * n**-0.2
    xs = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 60)
    exact = np.array([np.exp(-((x - v) ** 2) / (2 * bw**2)).sum() for x in xs]) / (n * bw * np.sqrt(2 * np.pi))
    np.testing.assert_allclose([m[0] for m in mine], xs, rtol=1e-9)
    np.testing.assert_allclose([m[1] for m in mine], exact, atol=1e-9)


def test_split_by_type(df):
    assert pr.split_by_type(df) == (["a", "b", "c"], ["s"])


def test_balance(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", None)], "d string, label int")
    rows = {(r["d"], r["label"]): (r["n"], r["ratio"]) for r in ba.class_balance(df, "label", ["d"]).collect()}
    assert rows == {("a", 0): (2, pytest.approx(2 / 3)), ("a", 1): (1, pytest.approx(1 / 3)), ("b", None): (1, 1.0)}
    shares = ba.value_share(df, "label", {0: "no", 1: "yes"}).collect()
    assert [(r["label"], r["count"]) for r in shares] == [("no", 2), (None, 1), ("yes", 1)]


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert {r["label"]: r["weight"] for r in ba.class_weights(df).collect()} == {0: pytest.approx(8 / 12), 1: 2.0}
    for limit in (1000, 1):
        rows = ba.with_class_weights(df, limit=limit)
        assert rows.count() == 8 and rows.agg(F.sum("weight")).first()[0] == pytest.approx(8.0)
    assert ba.pos_weight(df).first()["pos_weight"] == 3.0
    assert ba.pos_weight(df.where("label = 0")).first()["pos_weight"] is None


def test_duplicates_count_null_keys_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x"), (None, None), (None, None), (None, None)], "k string, d string")
    assert ba.duplicate_count(df, ["k", "d"]).first()[0] == 3
    assert ba.duplicate_count(df.limit(0), ["k", "d"]).first()[0] == 0


def test_crosstab(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "g string, l int")
    assert {(r["g"], r["l"]): r["n"] for r in ba.crosstab(df, "g", "l").collect()} == {("a", 0): 1, ("a", 1): 1, ("b", 1): 1}
    assert {r["g"]: (r["l_0"], r["l_1"]) for r in ba.crosstab_wide(df, "g", "l", [0, 1]).collect()} == {"a": (1, 1), "b": (0, 1)}


def test_latency_and_cost(spark):
    runs = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 6.0)], "model string, seconds double")
    summary = ba.latency_summary(runs, ["model"], "seconds", 300)
    row = summary.first()
    assert (row["mean_seconds"], row["median_seconds"], row["throughput_per_second"]) == (3.0, 2.0, 100.0)
    assert row["std_seconds"] == pytest.approx(np.std([1, 2, 6]))
    rates = spark.createDataFrame([("m", 0.001)], "model string, rate_per_second double")
    assert ba.cost_per_million(summary, rates, "model", 300).first()["cost_per_million"] == pytest.approx(10.0)


def test_qcut_equals_pandas(spark, pdf):
    scores = np.round(np.random.default_rng(2).random(500), 3)
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "id int, p double")
    got = {r["id"]: r["segment"] for r in sg.qcut(df, "p").collect()}
    expected = pd.qcut(scores, [0, 0.4, 0.7, 0.9, 1.0], labels=["low", "medium", "high", "critical"])
    assert [got[i] for i in range(500)] == list(expected)


def test_qcut_refuses_repeated_edges(spark):
    with pytest.raises(ValueError, match="not unique"):
        sg.qcut(spark.createDataFrame([(1.0,)] * 10, "p double"), "p")


def test_segments(spark):
    raw = spark.createDataFrame([(1, 9, 10.0), (2, 9, 20.0), (3, 9, 30.0)], "entity_id int, label int, Balance double")
    preds = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.9)], "entity_id int, label int, probability double")
    joined = sg.join_predictions(raw, preds)
    assert sorted(joined.columns) == ["Balance", "entity_id", "label", "probability"] and joined.count() == 2
    parts = sg.qcut(joined, "probability", [0, 0.5, 1], ["low", "high"])
    rows = {r["segment"]: r for r in sg.segment_summary(parts, averages={"avg_balance": "Balance"}, formatted=True).collect()}
    assert rows["high"]["churn_rate"] == "100.0%" and rows["low"]["avg_balance"] == 10.0
    assert sg.segment_filter(parts, "high").count() == 1


def test_pruned_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = plan_of(ba.class_balance(df.where("l_quantity > 10"), "l_returnflag"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan and "GreaterThan(l_quantity,10.0)" in plan
