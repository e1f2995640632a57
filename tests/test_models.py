from itertools import permutations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from helpers import plan_of
from riskloom.operators import attribution as at
from riskloom.operators import evaluate as ev
from riskloom.operators import models as mo
from riskloom.operators.sampling import stratified_split


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 1200
    x = rng.normal(size=(n, 3))
    g = rng.choice(["u", "v", "w"], n)
    label = ((x[:, 0] + 0.5 * x[:, 1] + (g == "u") + rng.normal(scale=0.3, size=n)) > 1).astype(int)
    rows = [(str(i), *map(float, x[i]), str(g[i]), int(label[i])) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id string, a double, b double, c double, g string, label int")


@pytest.fixture(scope="module")
def parts(table):
    split = stratified_split(table)
    return split.where("split = 'train'"), split.where("split = 'valid'")


@pytest.fixture(scope="module")
def model(parts):
    return mo.train_churn(parts[0], ["a", "b", "c"], ["g"], rounds=8, depth=3, rate=0.3)


def auc_of(scored, column="probability"):
    return ev.ranking_metrics(ev.score_counts(scored, column)).first()["roc_auc"]


def test_trees_learn_and_repeat(parts, model):
    scored = mo.score_batch(model, parts[1])
    assert scored.columns == ["entity_id", "label", "probability", "prediction"]
    assert auc_of(scored) > 0.93
    again = mo.score_batch(mo.train_churn(parts[0], ["a", "b", "c"], ["g"], rounds=8, depth=3, rate=0.3), parts[1])
    assert scored.exceptAll(again).isEmpty()


def test_fraud_weights(parts):
    weighted = mo.with_positive_weight(parts[0], out="w")
    sums = {r["label"]: r["s"] for r in weighted.groupBy("label").agg(F.sum("w").alias("s")).collect()}
    assert sums[0] == pytest.approx(sums[1])
    model = mo.train_fraud(parts[0], ["a", "b", "c"], rounds=4, depth=3)
    assert auc_of(mo.score_batch(model, parts[1])) > 0.85


def test_importance_and_history(parts, model):
    rows = mo.feature_importance(model).collect()
    assert rows[0]["feature"] == "a" and {r["feature"] for r in rows} == {"a", "b", "c", "g"}
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    history = [r["loss"] for r in mo.training_history(model, parts[1]).orderBy("iteration").collect()]
    assert len(history) == 8 and history[-1] < history[0]


def test_save_and_load(parts, model, tmp_path):
    mo.save_model(model, str(tmp_path / "m"))
    assert mo.score_batch(mo.load_model(str(tmp_path / "m")), parts[1]).exceptAll(mo.score_batch(model, parts[1])).isEmpty()


def test_unseen_category_and_missing_number(parts, model):
    odd = parts[1].limit(3).withColumn("g", F.lit("new")).withColumn("a", F.lit(None).cast("double"))
    assert mo.score_batch(model, odd).where("probability is not null").count() == 3


def test_missing_numbers_are_split_off(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), None if i % 3 == 0 else (float("nan") if i % 3 == 1 and i % 2 else float(x)), int(i % 3 == 0 or (i % 3 == 1 and i % 2)))
            for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "entity_id string, a double, label int")
    scored = mo.score_batch(mo.train_boosted(df, ["a"], rounds=2, depth=2, row_share=1.0, column_share=1.0), df)
    assert auc_of(scored) == 1.0


def test_encode_categories(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), (None,)], "g string")
    assert {r["g"]: r["g_code"] for r in mo.encode_categories(df, ["g"]).collect()} == {"a": 0.0, "b": 1.0, None: 2.0}


def test_codes_of_many_categories(spark, monkeypatch):
    monkeypatch.setattr(mo, "SENT_VALUES", 5)
    rng = np.random.default_rng(2)
    names = [f"é{i}" if i % 2 else f"n{i}" for i in rng.permutation(300)]
    rows = [(i, names[0] if i % 3 == 0 else names[int(rng.integers(0, 300))], int(rng.integers(0, 4))) for i in range(2000)] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "i int, g string, h int").repartition(6)
    got = {r["i"]: r for r in mo.encode_categories(df, ["g", "h"]).collect()}
    order = {v: k for k, v in enumerate(sorted({g for _, g, _ in rows if g}, key=lambda v: v.encode()))}
    assert len(got) == 2001 and all(got[i]["g_code"] == order.get(g, len(order)) and got[i]["h_code"] == (4 if h is None else h) for i, g, h in rows)
    table = mo.category_table(df, "g")
    assert {r["value"]: r["code"] for r in table.collect()} == order and "StringIndexer" not in plan_of(table, "simple")


def test_anomaly_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 2)) @ rng.normal(size=(2, 5)) + 0.1 * rng.normal(size=(500, 5))
    label = np.zeros(500, int)
    label[:25] = 1
    x[:25] += rng.normal(scale=3, size=(25, 5))
    columns = list("pqrst")
    df = spark.createDataFrame([(i, int(label[i]), *map(float, x[i])) for i in range(500)], "entity_id int, label int, " + ", ".join(f"{c} double" for c in columns))
    model = mo.train_anomaly(df, columns, components=2)
    legit = x[label == 0]
    z = (x - legit.mean(0)) / legit.std(0)
    zl = z[label == 0]
    _, vectors = np.linalg.eigh(np.cov(zl.T))
    top = vectors[:, -2:]
    errors = ((z - z @ top @ top.T) ** 2).mean(1)
    rows = {r["entity_id"]: r for r in model.score(df).collect()}
    np.testing.assert_allclose([rows[i]["reconstruction_error"] for i in range(500)], errors, atol=1e-9)
    assert model.threshold == pytest.approx(np.percentile(errors[label == 0], 97.5), abs=1e-9)
    assert sum(r["prediction"] for r in rows.values()) == (errors >= model.threshold - 1e-12).sum()
    assert auc_of(model.score(df), "reconstruction_error") > 0.95
    model.save(str(tmp_path / "anomaly"))
    with pytest.raises(Exception, match="missing value"):
        model.score(df.withColumn("p", F.lit(None).cast("double"))).collect()
    again = mo.AnomalyModel.load(spark, str(tmp_path / "anomaly"))
    assert again.score(df).exceptAll(model.score(df)).isEmpty()


def test_linear_attribution(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 6.0)], "entity_id int, a double, b double")
    rows = {r["entity_id"]: r for r in at.linear_attribution(df, {"a": 2.0, "b": -1.0}).collect()}
    assert (rows[1]["a"], rows[1]["b"]) == (-2.0, 2.0)
    ranked = at.mean_abs_attribution(at.linear_attribution(df, {"a": 3.0, "b": -1.0}), ["a", "b"]).collect()
    assert [(r["feature"], r["mean_abs_shap"]) for r in ranked] == [("a", 3.0), ("b", 2.0)]


def test_attributions_add_up_to_the_margin(parts, model):
    rows = parts[1].limit(200)
    names = mo.input_names(model)
    got = at.tree_attribution(model, rows).withColumn("total", sum((F.col(n) for n in names), F.col("base")))
    margin = PipelineModel(model.stages).transform(rows).select("entity_id", F.col("__probability").alias("p"))
    from pyspark.ml.functions import vector_to_array

    joined = got.join(margin, "entity_id").select("total", vector_to_array("p")[1].alias("p")).collect()
    totals = np.array([r["total"] for r in joined])
    np.testing.assert_allclose(1 / (1 + np.exp(-2 * totals)), [r["p"] for r in joined], atol=1e-9)


def shapley_by_orders(value, keep, met):
    """Average marginal contribution over all orders of the features."""
    m = len(keep)
    out = np.zeros(m)
    orders = list(permutations(range(m)))
    for order in orders:
        current = value * np.prod(keep)
        known = set()
        for i in order:
            known.add(i)
            after = value * np.prod([met[j] if j in known else keep[j] for j in range(m)])
            out[i] += after - current
            current = after
    return out / len(orders)


def meets(x, kind, limit):
    if kind == "le":
        return bool(x <= limit)
    return not x <= limit if kind == "gt" else (x in limit) == (kind == "in")


@pytest.mark.parametrize("features", [1, 2, 5, 6])
def test_path_attributions_equal_brute_force(features, monkeypatch):
    rng = np.random.default_rng(features)
    leaves = []
    for _ in range(23):
        tests = []
        for f in [*rng.permutation(features)[: rng.integers(0, features + 1)], *rng.integers(0, features, 2)]:
            kind = str(rng.choice(["le", "gt", "in", "out"]))
            limit = rng.choice(4, rng.integers(1, 3), replace=False).astype(float).tolist() if kind in ("in", "out") else float(rng.integers(0, 4))
            tests.append((int(f), float(rng.choice([0.0, 0.2, 0.7, 1.0])), (kind, limit)))
        leaves.append((float(rng.normal()), tests))
    x = rng.integers(0, 5, (40, features)).astype(float)
    x[3, 0], x[4, 0], x[5, 0] = np.nan, -np.inf, np.inf
    monkeypatch.setattr(at, "PATH_CELLS", 500)
    out = np.zeros_like(x)
    for paths in at.packed_paths(leaves):
        paths.add(x, out)
    for row in range(40):
        expected = np.zeros(features)
        for value, tests in leaves:
            names = sorted({f for f, _, _ in tests})
            if names:
                keep = [np.prod([s for g, s, _ in tests if g == f]) for f in names]
                met = [all(meets(x[row, g], *t) for g, _, t in tests if g == f) for f in names]
                expected[names] += shapley_by_orders(value, keep, met)
        np.testing.assert_allclose(out[row], expected, atol=1e-12)


def test_paths_of_600_deep_trees_are_small():
    import pickle

    rng = np.random.default_rng(0)
    tests = lambda: [(int(f), 0.5, ("le", float(rng.normal()))) for f in rng.integers(0, 30, 6)]
    packed = at.packed_paths([(0.1, tests()) for _ in range(600 * 64)])
    assert len(pickle.dumps(packed)) < 20e6


def test_anomaly_query_takes_whole_vectors(spark, sf_dir):
    from catalog import modelling

    rows, names = modelling._vectors(spark, sf_dir)
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(20).collect()}
    got = {r.entity_id: [r[n] for n in names] for r in rows.where(rows.entity_id.isin(*vectors)).collect()}
    assert got == vectors


def test_saved_models_are_compared_in_place(spark, sf_dir):
    from catalog import modelling

    out = modelling.saved_models(spark, sf_dir)
    # No row moves to meet its other score: only counts by label do.
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().toString()) and "hashpartitioning(entity_id" not in plan
    assert {r["model"] for r in out.collect()} == {"trees", "linear", "neural"} and out.where("n <> same or n = 0").isEmpty()
