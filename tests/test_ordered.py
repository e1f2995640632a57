import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordered


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(v, 2)), float(w), int(k)) for v, w, k in zip(rng.normal(size=3000), rng.exponential(size=3000), rng.integers(0, 4, 3000))]
    # A third of the rows holds one value.
    rows += [(0.5, 0.0, 1)] * 1500
    return rows, spark.createDataFrame(rows, "a double, b double, g int")


PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.975, 1.0]


@pytest.mark.parametrize("buckets", [2, 8, 300])
def test_exact_quantiles_equal_numpy(sample, buckets):
    rows, df = sample
    cuts = ordered.cut_points(df, ["a", "b"], buckets)
    found = ordered.exact_quantiles(df, ["a", "b"], PROBS, cuts=cuts)
    for i, c in enumerate("ab"):
        np.testing.assert_allclose(found[c], np.quantile([r[i] for r in rows], PROBS), rtol=0, atol=1e-12)


@pytest.mark.parametrize("limit", [100, 1, 0])
def test_large_buckets_are_cut_again(sample, monkeypatch, limit):
    rows, df = sample
    monkeypatch.setattr(ordered, "SORTED_VALUES", limit)
    monkeypatch.setattr(ordered, "QUANTILE_BUCKETS", 3)
    monkeypatch.setattr(ordered, "REFINED_BUCKETS", 4)
    found = ordered.exact_quantiles(df, ["a", "b"], PROBS, cuts={"a": ordered.cut_points(df, ["a"], 50)["a"]})
    for i, c in enumerate("ab"):
        np.testing.assert_allclose(found[c], np.quantile([r[i] for r in rows], PROBS), rtol=0, atol=1e-12)


def test_exact_quantiles_do_not_depend_on_the_layout(sample):
    _, df = sample
    results = [ordered.exact_quantiles(df.repartition(n), ["a"], PROBS) for n in (1, 4, 50)]
    assert results[0] == results[1] == results[2]


def test_quantiles_of_missing_nan_and_infinite_values(spark):
    df = spark.createDataFrame([(None, None), (float("nan"), None), (1.0, None), (float("inf"), None), (-0.0, None), (0.0, None)], "a double, b double")
    assert ordered.exact_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0]) == {"a": [0.0, 0.5, float("inf")], "b": [None] * 3}


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 4)], "v double, n int")
    expected = np.quantile([1, 1, 1, 2, 5, 5, 5, 5], PROBS)
    np.testing.assert_allclose(ordered.exact_quantiles(df, ["v"], PROBS, weight="n")["v"], expected)


def test_column_names_do_not_collide(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0, 9.0)] * 2, "w double, value double, bucket double, feature double")
    found = ordered.exact_quantiles(df, df.columns, [0.5])
    assert found == {"w": [1.0], "value": [5.0], "bucket": [2.0], "feature": [9.0]}


def test_grouped_quantiles(sample):
    rows, df = sample
    for r in ordered.grouped_quantiles(df, ["g"], "a", PROBS).collect():
        np.testing.assert_allclose(r["quantiles"], np.quantile([x[0] for x in rows if x[2] == r["g"]], PROBS), atol=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(sample, descending):
    rows, df = sample
    bucketed = ordered.long_values(df, ordered.cut_points(df, ["a"], 8))
    run = ordered.running_sums(bucketed, {"n": F.count(F.lit(1))}, descending=descending).collect()
    values = np.array([r[0] for r in rows])
    assert len(run) == len(set(values + 0.0))
    for r in run:
        assert r["run_n"] == ((values >= r["value"]) if descending else (values <= r["value"])).sum()
        assert r["all_n"] == len(values)


def test_negative_zero_meets_zero(spark):
    df = spark.createDataFrame([(-0.0,), (0.0,), (0.0,), (-1.0,)], "a double")
    run = ordered.running_sums(ordered.long_values(df, {"a": [-0.0, 0.5]}), {"n": F.count(F.lit(1))}).collect()
    assert sorted((r["value"], r["n"]) for r in run) == [(-1.0, 1), (0.0, 3)]


@pytest.mark.parametrize("sorted_hashes", [1_000_000, 3, 0])
def test_hash_thresholds(spark, monkeypatch, sorted_hashes):
    # A small limit takes more rounds, none takes all bits.
    monkeypatch.setattr(ordered, "SORTED_HASHES", sorted_hashes)
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id"))
    hashed = F.shiftrightunsigned(F.xxhash64("id"), 4)
    limits = ordered.hash_thresholds(df, ["g"], hashed, 60, {(0,): 100, (1,): 0})
    counts = {r["g"]: r["n"] for r in df.withColumn("h", hashed).groupBy("g").agg(F.count_if(F.col("h") <= limits[(0,)]).alias("n")).collect()}
    assert counts[0] == 100 and limits[(1,)] == -1
    ranked = sorted(r[0] for r in df.select(hashed).collect())
    assert ordered.hash_thresholds(df, [], hashed, 60, {(): 123})[()] == ranked[122]
    everything = ordered.hash_thresholds(df, [], hashed, 60, {(): 5000})[()]
    assert df.where(hashed <= F.lit(everything)).count() == 1000


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "a", 3.0), ("x", None, 5.0)], "g string, h string, v double")
    got = {(r["g"], r["h"]): r["quantiles"] for r in ordered.grouped_quantiles(df, ["g", "h"], "v", [0.5]).collect()}
    assert got == {(None, "a"): [2.0], ("x", None): [5.0]}


def test_running_sums_read_the_table_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    run = ordered.running_sums(ordered.long_values(df, ordered.cut_points(df, ["l_extendedprice"])), {"n": F.count(F.lit(1))}, by=["feature"])
    run.collect()
    plan = run._jdf.queryExecution().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_hot_hash_is_found(spark):
    # Half of the rows share one key: the rank lies among its copies.
    df = spark.range(2000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("id"))
    hashed = F.shiftrightunsigned(F.xxhash64("id"), 4)
    ranked = sorted(r[0] for r in df.select(hashed).collect())
    for rank in (1, 900, 1100, 2000):
        assert ordered.hash_thresholds(df, [], hashed, 60, {(): rank})[()] == ranked[rank - 1]
