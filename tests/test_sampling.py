from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import sampling as sa
from riskloom.operators import scaling as sc

from helpers import plan_of


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5003).select(F.col("id").cast("string").alias("entity_id"), (F.col("id") % 10 == 0).cast("int").alias("label"), "id")


def test_exact_counts_per_label(rows):
    parts = sa.stratified_split(rows)
    got = {(r["label"], r["split"]): r["count"] for r in parts.groupBy("label", "split").count().collect()}
    # 5003 rows, 501 of them positive: 4002 for training.
    assert got == {(0, "train"): 3601, (0, "valid"): 901, (1, "train"): 401, (1, "valid"): 100}


def test_split_does_not_depend_on_layout_and_moves_no_row(rows):
    one, many = (sa.stratified_split(rows.repartition(n)) for n in (1, 30))
    assert one.exceptAll(many).isEmpty()
    assert "Exchange" not in plan_of(sa.stratified_split(rows))
    other = sa.stratified_split(rows, seed=7)
    assert not one.exceptAll(other).isEmpty()


def test_equal_keys_stay_together(spark):
    df = spark.range(3000).select((F.col("id") % 100).cast("string").alias("entity_id"), F.lit(1).alias("label"))
    parts = sa.stratified_split(df).groupBy("entity_id").agg(F.count_distinct("split").alias("k"))
    assert parts.where("k > 1").isEmpty()


def test_null_label_and_empty_table(spark):
    df = spark.createDataFrame([(str(i), None if i % 2 else 1) for i in range(100)], "entity_id string, label int")
    got = {(r["label"], r["split"]): r["count"] for r in sa.stratified_split(df).groupBy("label", "split").count().collect()}
    assert got == {(None, "train"): 40, (None, "valid"): 10, (1, "train"): 40, (1, "valid"): 10}
    assert sa.stratified_split(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [100_000, 10])
def test_split_of_thousands_of_labels(spark, monkeypatch, sent):
    monkeypatch.setattr(sa, "SENT_LABELS", sent)
    df = spark.range(12_000).select(F.col("id").alias("entity_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3000).alias("label"))
    out = sa.stratified_split(df)
    counts = {r["label"]: (r["n"], r["v"]) for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "valid").alias("v")).collect()}
    assert len(counts) == 2001 and sum(n for n, _ in counts.values()) == 12_000 and sum(v for _, v in counts.values()) == 2400
    assert counts[None] == (4000, 800) and {v for n, v in counts.values() if n == 4} == {0, 1} and out.columns == [*df.columns, "split"]


def test_samples(rows):
    small = sa.sample_n(rows, 100, ["id"])
    assert small.count() == 100 and small.exceptAll(rows).isEmpty()
    assert sa.sample_n(rows, 10_000, ["id"]).count() == 5003
    with pytest.raises(ValueError):
        sa.sample_n(rows, 10_000, ["id"], strict=True)


def test_repeated_keys_give_exactly_n(spark):
    rows = spark.range(0, 20_000).selectExpr("id % 3 AS k", "id AS v")
    for n in (1, 9_999, 12_001):
        got = sa.sample_n(rows, n, ["k"])
        assert got.count() == n == got.distinct().count()
    assert sa.sample_fraction(rows, 0.333, ["k"], exact=True).count() == 6660


def test_fractions_and_complement(rows):
    assert sa.sample_fraction(rows, 0.3, ["id"], exact=True).count() == round(0.3 * 5003)
    assert abs(sa.sample_fraction(rows, 0.3, ["id"]).count() / 5003 - 0.3) < 0.03
    reference, current = sa.complement_split(rows, 0.5, ["id"])
    assert reference.count() + current.count() == 5003 and reference.join(current, "id").isEmpty()
    _, again = sa.complement_split(rows, 1.0, ["id"])
    assert again.isEmpty()


def test_scaling(spark):
    values = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(i, float(v), 3.0, int(v > 4)) for i, v in enumerate(values)], "id int, x double, c double, label int")
    scaled = {r["id"]: r for r in sc.min_max_scale(df, ["x", "c"], "_s").collect()}
    np.testing.assert_allclose([scaled[i]["x_s"] for i in range(4)], (values - 1) / (8 + 1e-12))
    assert scaled[0]["c_s"] == 0.0
    fit = values[values <= 4]
    got = {r["id"]: r for r in sc.standard_scale(df, ["x", "c"], F.col("label") == 0).collect()}
    np.testing.assert_allclose([got[i]["x"] for i in range(4)], (values - fit.mean()) / fit.std())
    assert got[3]["c"] == 0.0


def test_perturb(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100).cast("double").alias("x"), F.lit(1.0).alias("c"), F.lit(None).cast("double").alias("n"))
    noisy = sc.perturb_numeric(df, ["x", "c", "n"], ["id"], 0.5)
    delta = noisy.alias("a").join(df.alias("b"), "id").select((F.col("a.x") - F.col("b.x")).alias("x"), (F.col("a.c") - 1).alias("c"), F.col("a.n").alias("n"))
    row = delta.agg(F.avg("x"), F.stddev_pop("x"), F.stddev_pop("c"), F.count("n")).first()
    assert abs(row[0]) < 0.5 and row[1] == pytest.approx(0.5 * 28.866, rel=0.03) and row[2] == pytest.approx(0.5, rel=0.03) and row[3] == 0
    # The deviation is a sum of doubles, so only the last digits depend on the layout.
    again = sc.perturb_numeric(df.repartition(9), ["x", "c", "n"], ["id"], 0.5)
    shown = lambda d: d.select("id", F.round("x", 8), F.round("c", 8))
    assert shown(noisy).exceptAll(shown(again)).isEmpty()
    assert sc.perturb_numeric(df, ["x"], ["id"], 0.0) is df


def test_a_key_of_most_rows_is_cut_by_counts(spark):
    rows = [(1, i) for i in range(1500)] + [(1, -1)] * 700 + [(i, 0) for i in range(2, 300)]
    df = spark.createDataFrame(rows, "k int, x int").repartition(5)
    for n in (1, 400, 1600, 2100, 2400):
        got = sa.sample_n(df, n, ["k"])
        plan = plan_of(got, "simple")
        assert "rangepartitioning" not in plan and "TakeOrdered" not in plan and "GlobalLimit" not in plan
        kept = Counter(map(tuple, got.collect()))
        assert sum(kept.values()) == n and not kept - Counter(rows)
        assert Counter(map(tuple, sa.sample_n(df.coalesce(1), n, ["k"]).collect())) == kept
