import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import __main__ as cli, session
from riskloom.operators import drift
from riskloom.operators.attribution import mean_abs_attribution, tree_attribution
from riskloom.operators.drift import feature_drift
from riskloom.operators.models import train_fraud
from riskloom.plans.training import attribution_step, run_training_pipeline
from riskloom.sources import sinks
from riskloom.sources.schemas import ANOMALY_SCORES, CHURN_RAW, FRAUD_RAW
from riskloom.streaming import jobs


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    rng = np.random.default_rng(9)
    n = 600
    v = rng.normal(size=(n, 28))
    label = (v[:, 0] + 0.3 * rng.normal(size=n) > 1.4).astype(int)
    v[label == 1] *= 2
    fraud = [(float(i * 60), *map(float, v[i]), float(round(abs(v[i, 1]) * 50, 2)), int(label[i])) for i in range(n)]
    age = rng.integers(20, 80, n)
    churn = [
        (i, 10_000 + i, "S", int(rng.integers(400, 850)), str(rng.choice(["France", "Spain", "Germany"])), str(rng.choice(["Female", "Male"])),
         int(age[i]), int(rng.integers(0, 10)), float(rng.random() * 1e5), int(rng.integers(1, 4)), 1, int(rng.integers(0, 2)),
         float(rng.random() * 1e5), int(age[i] + rng.normal(scale=5) > 60))
        for i in range(n)
    ]
    sinks.write_csv_table(spark.createDataFrame(churn, CHURN_RAW), f"{root}/bank_churn/Churn_Modelling.csv")
    sinks.write_csv_table(spark.createDataFrame(fraud, FRAUD_RAW), f"{root}/creditcard_fraud/creditcard.csv")
    return root


def test_training_pipeline(spark, raw, tmp_path):
    out = str(tmp_path)
    options = {"rounds": 3, "depth": 3}
    steps = run_training_pipeline(
        spark, f"{out}/store", f"{out}/artifacts", raw_dir=raw, log_path=f"{out}/runs", fraud_options=options, churn_options=options, sample=50
    )
    assert steps["fraud"].metrics["roc_auc"] > 0.9 and steps["churn"].metrics["roc_auc"] > 0.85
    assert steps["anomaly"].metrics["threshold"] == steps["anomaly"].extra["threshold"]
    assert steps["attribution"].extra["sample_size"] == 50
    predictions = spark.read.option("header", True).csv(f"{out}/artifacts/fraud/trees/validation_predictions")
    assert predictions.columns == ["entity_id", "label", "probability", "prediction"] and predictions.count() == 120
    assert spark.read.json(f"{out}/artifacts/validation").where("not success").isEmpty()
    log = spark.read.parquet(f"{out}/runs")
    assert log.where("kind = 'metric'").count() == 9 and log.select("run_id").distinct().count() == 1
    ranked = spark.read.option("header", True).csv(f"{out}/artifacts/fraud/attribution/shap_importance")
    assert ranked.count() == 32 and ranked.orderBy(F.col("mean_abs_shap").cast("double").desc()).first()["feature"] == "V1"
    again = run_training_pipeline(spark, f"{out}/store", f"{out}/more", skip_churn=True, validate=False, fraud_options=options, sample=20)
    assert again["churn"] is None and again["fraud"].metrics == pytest.approx(steps["fraud"].metrics)


def test_attribution_reads_every_row(spark, tmp_path):
    n = 5600
    rows = spark.range(n).select(F.col("id").alias("entity_id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    model = train_fraud(rows, ["x"], rounds=1, depth=2)
    step = attribution_step(model, rows, str(tmp_path))
    whole = mean_abs_attribution(tree_attribution(model, rows), ["x"]).first()["mean_abs_shap"]
    assert step.extra["sample_size"] == n
    assert float(spark.read.option("header", True).csv(step.paths["importance"]).first()["mean_abs_shap"]) == pytest.approx(whole)


def test_command_line(spark, raw, tmp_path):
    out = str(tmp_path)
    store = f"{out}/store"
    cli.main(["build-store", "--raw-dir", raw, "--processed-dir", f"{out}/processed", "--feature-store", store])
    cli.main(["validate", "--feature-store", store, "--report", f"{out}/report"])
    assert spark.read.json(f"{out}/report").count() == 7
    rng = np.random.default_rng(1)
    rows = [(str(i), int(i % 3 == 0), float(rng.random()), 0) for i in range(200)]
    sinks.write_csv_table(spark.createDataFrame(rows, ANOMALY_SCORES), f"{out}/scores")
    cli.main(["evaluate", "--scores", f"{out}/scores", "--output-dir", f"{out}/evaluation", "--anomaly", "--n-bins", "5", "--threshold-steps", "7"])
    assert spark.read.option("header", True).csv(f"{out}/evaluation/threshold_metrics").count() == 7
    assert spark.read.option("header", True).csv(f"{out}/evaluation/calibration").count() == 5
    summary = spark.read.json(f"{out}/evaluation/summary").first()
    assert 0.3 < summary["roc_auc"] < 0.7 and summary["best_threshold"]["f1"] > 0
    cli.main(["drift", "--reference", store, "--current", store, "--dataset", "churn", "--output-dir", f"{out}/drift"])
    features = spark.read.json(f"{out}/drift/features")
    assert features.count() == 14 and features.where("has_alert").isEmpty()
    assert spark.read.json(f"{out}/drift/header").first()["reference_rows"] == 600


def test_failed_validation_stops_after_the_report(spark, tmp_path):
    bad = spark.createDataFrame([("1", "loan", "{}", 0)], "entity_id string, dataset string, features string, label int")
    sinks.write_parquet(bad, f"{tmp_path}/store", ["dataset"])
    with pytest.raises(ValueError, match="dataset_values_valid"):
        run_training_pipeline(spark, f"{tmp_path}/store", f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/validation").count() == 7


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 10} 0{i % 10}:00:00", float(i), "error" if i % 4 == 0 else "view") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, t string, value double, kind string").select("id", F.col("t").cast("timestamp_ntz").alias("ts"), "value", "kind")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), df, str(tmp_path)


def test_class_rate(spark, stream):
    events, _, path = stream
    rates = jobs.class_rate(events, "ts", F.col("kind") == "error")
    jobs.write_stream(rates, f"{path}/out", f"{path}/cp").awaitTermination()
    rows = spark.read.parquet(f"{path}/out").orderBy("window_start").collect()
    # The last day is still open.
    assert [(r["n"], r["positives"]) for r in rows] == [(10, 3), (10, 2)]
    assert rows[0]["rate"] == 0.3


def test_every_window_once(spark, stream, tmp_path):
    _, df, path = stream
    for i, day in enumerate((1, 2, 3)):
        df.where(F.dayofmonth("ts") == day).coalesce(1).write.parquet(f"{path}/parts/{i}")
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/parts")
    rates = jobs.class_rate(events, "ts", F.col("kind") == "error", delay="10 days")
    jobs.write_windows(rates, f"{path}/out", f"{path}/cp").awaitTermination()
    rows = spark.read.parquet(f"{path}/out").orderBy("window_start").collect()
    assert [(r["n"], r["positives"]) for r in rows] == [(10, 3), (10, 2), (10, 3)]


def test_stream_drift_reads_the_reference_once(spark, stream):
    _, df, path = stream
    df.repartition(3, "id").write.parquet(f"{path}/parts")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    reference = df.where("id < 20").withColumn("value", counted("value"))
    stored = drift.store_reference(reference, ["value", "kind", "id"], f"{path}/reference", time_column="ts")
    before = seen.value
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/parts")
    jobs.stream_drift(events, drift.load_reference(spark, f"{path}/reference"), [], f"{path}/out", f"{path}/cp").awaitTermination()
    got = spark.read.parquet(f"{path}/out")
    assert got.select("batch_id").distinct().count() == 3 and seen.value == before > 0
    whole = drift.drift_from_reference(stored, df)
    assert whole.exceptAll(feature_drift(df.where("id < 20"), df, ["value", "kind", "id"])).isEmpty() and whole.count() == 3
    assert stored.metadata.first()["rows"] == 20
    with pytest.raises(KeyError):
        drift.drift_from_reference(stored, df.drop("kind"))
    with pytest.raises(ValueError):
        drift.drift_from_reference(stored, df.withColumn("value", F.col("kind")))


def test_stream_features_equal_batch(spark, stream):
    events, df, path = stream
    jobs.write_stream(jobs.stream_features(events, "value", "id"), f"{path}/out", f"{path}/cp").awaitTermination()
    assert spark.read.parquet(f"{path}/out").exceptAll(jobs.stream_features(df, "value", "id")).isEmpty()


def test_stream_drift_equals_batch(spark, stream):
    events, df, path = stream
    reference = df.where("id < 10")
    jobs.stream_drift(events, reference, ["value", "kind"], f"{path}/out", f"{path}/cp").awaitTermination()
    got = spark.read.parquet(f"{path}/out")
    expected = feature_drift(reference, df, ["value", "kind"])
    assert got.select("batch_id").distinct().count() == 1
    assert got.select(*expected.columns).exceptAll(expected).isEmpty()


def test_staging(spark):
    staged = session.stage(spark.range(5), "five")
    assert staged.count() == 5 and session.shared_dir(spark) in staged.inputFiles()[0]
    assert session.shared_dir(spark) == session.shared_dir(spark)


class FakeConf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class FakeSession:
    """Only what the folder lookup reads."""

    def __init__(self, master, **conf):
        self.conf = FakeConf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()


def test_folder_lookup():
    named = FakeSession("spark://host", **{session.CHECKPOINT_CONF: "hdfs://shared/"})
    assert session.staged_path(named, "x").startswith("hdfs://shared/riskloom/app-1/x-")
    with pytest.raises(RuntimeError, match="shared by all executors"):
        session.shared_dir(FakeSession("spark://host"))
    local = FakeSession("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)


def test_dropping_staged_tables(spark):
    session.stage(spark.range(1), "one")
    assert session.drop_staged(spark) is True
    assert session.stage(spark.range(1), "two").count() == 1
