"""The neural anomaly model against plain NumPy, over different layouts of the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import auc
from riskloom.operators import autoencoder as ae
from riskloom.operators import models as mo


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.maximum(rng.normal(size=(900, 3)) @ rng.normal(size=(3, 8)), -0.5) + 0.05 * rng.normal(size=(900, 8))
    label = (np.arange(900) % 20 == 0).astype(int)
    x[label == 1] = rng.normal(scale=1.5, size=(int(label.sum()), 8))
    x[300:320] = x[300]
    columns = [f"c{i}" for i in range(8)]
    rows = [(i, int(label[i]), *map(float, x[i])) for i in range(900)]
    return spark.createDataFrame(rows, "entity_id int, label int, " + ", ".join(f"{c} double" for c in columns)), columns, x, label


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    weights = ae.initial_weights(5, 4, 3, seed=1)
    rows, counts = rng.normal(size=(7, 5)), rng.integers(1, 4, 7).astype(float)
    flat, loss = ae.gradients(rows, counts, weights)
    assert loss == pytest.approx((counts * ae.row_errors(rows, weights)).sum())
    values = ae._flat(weights)
    for k in rng.choice(len(values), 25, replace=False):
        up, down = values.copy(), values.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        change = sum(s * (counts * ae.row_errors(rows, ae._shaped(v, weights))).sum() for s, v in ((1, up), (-1, down)))
        assert flat[k] == pytest.approx(change / 2e-6, abs=1e-5)


def test_steps_of_a_task_that_holds_the_rows_equal_jobs(table, monkeypatch):
    df, columns, _, _ = table
    monkeypatch.setattr(ae, "PACK_ROWS", 40)

    def fit():
        return ae.train_autoencoder(df, columns, hidden=16, latent=4, epochs=3, batch_rows=250, rate=0.01)

    steps, plain = [], ae.batch_gradient
    monkeypatch.setattr(ae, "batch_gradient", lambda *a: steps.append(1) or plain(*a))
    one = fit()
    # The steps do not take a job each: 50 epochs of up to 64 steps were 3,200 jobs.
    assert not steps
    monkeypatch.setattr(ae, "HELD_VALUES", 0)
    other = fit()
    assert len(steps) == 12
    assert all((a == b).all() for a, b in zip(one.weights, other.weights)) and other.losses == one.losses


def test_one_batch_is_plain_adam(table):
    df, columns, x, label = table
    model = ae.train_autoencoder(df, columns, hidden=12, latent=4, epochs=6, rate=0.01)
    legit = x[label == 0]
    z = (legit - legit.mean(0)) / legit.std(0)
    weights = ae.initial_weights(8, 12, 4, seed=42)
    values, adam, losses = ae._flat(weights), ae.Adam(sum(w.size for w in weights), 0.01), []
    for _ in range(6):
        gradient, loss = ae.gradients(z, np.ones(len(z)), ae._shaped(values, weights))
        values = adam.step(values, gradient / len(z))
        losses.append(loss / len(z))
    np.testing.assert_allclose(model.losses, losses, rtol=1e-9)
    np.testing.assert_allclose(ae._flat(model.weights), values, atol=1e-7)


def test_the_same_model_for_any_layout(table, spark, monkeypatch, tmp_path):
    df, columns, x, label = table
    monkeypatch.setattr(ae, "PACK_ROWS", 40)
    monkeypatch.setattr(ae, "SUMS", 2)
    models = [
        ae.train_autoencoder(d, columns, hidden=16, latent=4, epochs=8, batch_rows=250, rate=0.01)
        for d in (df.coalesce(1), df.repartition(7, F.rand(1)), df.orderBy(F.desc("c1")))
    ]
    for other in models[1:]:
        assert all((a == b).all() for a, b in zip(models[0].weights, other.weights))
        assert other.losses == models[0].losses and other.threshold == pytest.approx(models[0].threshold, rel=1e-5)
    model = models[0]
    assert model.losses[-1] < 0.6 * model.losses[0] and len(model.losses) == 8
    history = mo.training_history(model).collect()
    assert [(r.iteration, r.loss) for r in history] == list(enumerate(model.losses, 1))

    scored = {r.entity_id: r for r in model.score(df).collect()}
    legit = x[label == 0]
    z = (x - legit.mean(0)) / legit.std(0)
    errors = ae.row_errors(z, model.weights)
    np.testing.assert_allclose([scored[i].reconstruction_error for i in range(900)], errors, rtol=1e-4)
    assert auc(errors, label) > 0.8
    assert model.threshold == pytest.approx(np.percentile(errors[label == 0], 97.5), rel=1e-4)
    assert all(scored[i].prediction == int(scored[i].reconstruction_error >= model.threshold) for i in range(900))

    model.save(str(tmp_path / "model"))
    again = ae.Autoencoder.load(spark, str(tmp_path / "model"))
    assert again.score(df).exceptAll(model.score(df)).isEmpty() and again.losses == model.losses


def test_missing_values_and_no_rows(table):
    df, columns, _, _ = table
    holes = df.withColumn("c3", F.when(F.col("entity_id") == 41, F.lit(None)).otherwise(F.col("c3")))
    with pytest.raises(Exception, match="missing value"):
        ae.train_autoencoder(holes, columns, epochs=1)
    model = ae.train_autoencoder(df, columns, hidden=4, latent=2, epochs=1)
    with pytest.raises(Exception, match="missing value"):
        model.score(holes).collect()
    with pytest.raises(ValueError, match="no rows"):
        ae.train_autoencoder(df.where("label = 1"), columns, epochs=1)


def test_equal_rows_are_one_row_with_a_count(table, spark):
    df, columns, _, _ = table
    row = mo.scaled_row(columns, [0.0] * 8, [1.0] * 8)
    packs, sizes = ae.pack(df.where("entity_id between 300 and 319").select(row.alias("x")))
    assert sizes == [20] and [list(r.counts) for r in packs.collect()] == [[20.0]]


def test_the_driver_is_sent_one_packed_gradient(table, spark, monkeypatch):
    df, columns, _, _ = table
    whole = np.array([0, 1, -1, 2**61, -(2**61), -(2**63), 2**63 - 1, 12345, -98765])
    assert (ae.received(ae.sent(whole), len(whole)) == whole).all()
    monkeypatch.setattr(ae, "PACK_ROWS", 16)
    monkeypatch.setattr(ae, "TASK_ROWS", 100)
    row = mo.scaled_row(columns, [0.0] * 8, [1.0] * 8)
    packs, sizes = ae.pack(df.where("label = 0").select(row.alias("x")))
    weights = ae.initial_weights(8)
    seen = []
    monkeypatch.setattr(ae, "received", lambda data, size, plain=ae.received: (seen.append((len(data), size)), plain(data, size))[1])
    many = ae.batch_gradient(packs, sizes[0], weights)
    parameters = sum(w.size for w in weights)
    # Slices of one gradient and the error, in fewer than eight bytes each, from any number of tasks.
    assert len(seen) == ae.SUMS and sum(n for _, n in seen) == parameters + 1 and sum(b for b, _ in seen) < 6.5 * parameters
    monkeypatch.setattr(ae, "TASK_ROWS", 10_000)
    one = ae.batch_gradient(packs, sizes[0], weights)
    assert len(seen) == ae.SUMS + 1 and (many[0] == one[0]).all() and many[1] == one[1]
