"""Models, attributions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.scalars import seconds_since
from riskloom.operators import attribution as at
from riskloom.operators import autoencoder as ae
from riskloom.operators import models as mo
from riskloom.operators.sampling import stratified_split
from riskloom.plans.feature_store import CHURN_FILE, FRAUD_FILE, build_feature_store
from riskloom.plans.training import run_training_pipeline
from riskloom.session import staged_path
from riskloom.sources import sinks
from riskloom.sources.readers import read_feature_store
from riskloom.sources.schemas import CHURN_RAW, FRAUD_RAW
from riskloom.streaming import jobs

from . import drifting
from .tables import CLEAN_FRAUD_SQL, CUSTOMERS_SQL, HALVES_SQL, LINE_COLUMNS, ORIGIN, customers, halves, rounded, table

# Few rounds: the queries show the work, the full number is the default of the operators.
ROUNDS = {"rounds": 5, "depth": 4}
WEIGHTS = {"l_quantity": 0.5, "l_extendedprice": -0.001, "l_discount": 40.0, "l_tax": 3.0}


def _items(spark, d):
    risky = (F.col("l_extendedprice") > 60_000) & (F.col("l_discount") > 0.05)
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("entity_id"), *LINE_COLUMNS, risky.cast("int").alias("label")
    )


def _parts(rows, keys=("entity_id",)):
    parts = stratified_split(rows, "label", keys)
    return parts.where("split = 'train'").drop("split"), parts.where("split = 'valid'").drop("split")


def fraud_model(spark, d):
    train, valid = _parts(_items(spark, d))
    model = mo.train_fraud(train, LINE_COLUMNS, **ROUNDS)
    path = staged_path(spark, "fraud-model")
    mo.save_model(model, path)
    return mo.score_batch(mo.load_model(path), valid)


def feature_importance(spark, d):
    train, _ = _parts(_items(spark, d))
    return mo.feature_importance(mo.train_fraud(train, LINE_COLUMNS, **ROUNDS))


def training_history(spark, d):
    train, valid = _parts(_items(spark, d))
    return mo.training_history(mo.train_fraud(train, LINE_COLUMNS, **ROUNDS), valid)


CHURN_NUMERIC = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "EstimatedSalary"]
CHURN_NOMINAL = ["Geography", "Gender"]


def churn_model(spark, d):
    rows = customers(spark, d).withColumnsRenamed({"CustomerId": "entity_id", "Exited": "label"})
    train, valid = _parts(rows)
    return mo.score_batch(mo.train_churn(train, CHURN_NUMERIC, CHURN_NOMINAL, **ROUNDS), valid)


#: Length of the vectors in ``embeddings``.
ENTRIES = 64


def _vectors(spark, d):
    names = [f"V{i}" for i in range(1, ENTRIES + 1)]
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("entity_id"),
        (F.col("label") == 0).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    return rows, names


def anomaly_model(spark, d):
    rows, names = _vectors(spark, d)
    train, valid = _parts(rows)
    model = mo.train_anomaly(train, names, components=10)
    path = staged_path(spark, "anomaly-model")
    model.save(path)
    return mo.AnomalyModel.load(spark, path).score(valid)


def _neural(spark, d):
    rows, names = _vectors(spark, d)
    train, valid = _parts(rows)
    return ae.train_autoencoder(train, names), valid


def neural_anomaly_model(spark, d):
    model, valid = _neural(spark, d)
    return model.score(valid)


def neural_anomaly_history(spark, d):
    return mo.training_history(_neural(spark, d)[0])


def saved_models(spark, d):
    """Rows per label, and how many of them get the same score from the model that was saved and loaded again."""
    rows, names = _vectors(spark, d)
    items = _items(spark, d)
    trees = mo.train_fraud(items, LINE_COLUMNS, **ROUNDS)
    linear, neural = mo.train_anomaly(rows, names, components=10), ae.train_autoencoder(rows, names, epochs=1)
    root = staged_path(spark, "models")
    mo.save_model(trees, f"{root}/trees")
    linear.save(f"{root}/linear")
    neural.save(f"{root}/neural")
    trees_score = lambda m, t, keep: mo.score_batch(m, t, keep)
    own_score = lambda m, t, keep: m.score(t, keep)
    kept = [
        _kept("trees", items, LINE_COLUMNS, trees_score, trees, mo.load_model(f"{root}/trees")),
        _kept("linear", rows, names, own_score, linear, mo.AnomalyModel.load(spark, f"{root}/linear")),
        _kept("neural", rows, names, own_score, neural, ae.Autoencoder.load(spark, f"{root}/neural")),
    ]
    return kept[0].union(kept[1]).union(kept[2])


def _kept(name, rows, columns, score, before, after):
    """Both models score each row where it is: no row moves to meet its other score."""
    first = score(before, rows, ("entity_id", "label", *columns))
    value, prediction = first.columns[-2:]
    first = first.withColumnsRenamed({value: "score_before", prediction: "prediction_before"})
    both = score(after, first, ("entity_id", "label", "score_before", "prediction_before"))
    same = F.col(value).eqNullSafe(F.col("score_before")) & F.col(prediction).eqNullSafe(F.col("prediction_before"))
    met = both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))
    return met.select(F.lit(name).alias("model"), "label", "n", "same")


def tree_attribution(spark, d):
    rows = _items(spark, d)
    train, _ = _parts(rows)
    model = mo.train_fraud(train, LINE_COLUMNS, rounds=3, depth=3)
    return at.mean_abs_attribution(at.tree_attribution(model, rows), LINE_COLUMNS)


def linear_attribution(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE_COLUMNS)
    return rounded(at.linear_attribution(rows, WEIGHTS, keep=("l_orderkey", "l_linenumber")), LINE_COLUMNS)


def mean_abs(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", *LINE_COLUMNS)
    out = at.mean_abs_attribution(at.linear_attribution(rows, WEIGHTS, keep=("l_orderkey",)), LINE_COLUMNS)
    return rounded(out, ["mean_abs_shap"])


def _raw_tables(spark, d):
    """Raw CSV files: customers, and events with the vector of their number as components."""
    vectors = table(spark, d, "embeddings")
    n = vectors.count()
    components = vectors.select(
        F.col("vec_id"), F.col("label").alias("kind"), *[F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(28)]
    )
    events = table(spark, d, "events").select(
        seconds_since("ts", ORIGIN).alias("Time"), F.col("value").alias("Amount"), (F.col("event_id") % n).alias("vec_id")
    )
    fraud = events.join(components, "vec_id").withColumn("Class", (F.col("kind") == 0).cast("int"))
    root = staged_path(spark, "raw")
    sinks.write_csv_table(customers(spark, d).select(*CHURN_RAW.names), f"{root}/{CHURN_FILE}")
    sinks.write_csv_table(fraud.select(*FRAUD_RAW.names), f"{root}/{FRAUD_FILE}")
    return root


def feature_store_build(spark, d):
    root = _raw_tables(spark, d)
    paths = build_feature_store(spark, root, f"{root}/processed", f"{root}/store")
    return read_feature_store(spark, paths.store).groupBy("dataset", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities")
    )


def training_pipeline(spark, d):
    root = _raw_tables(spark, d)
    steps = run_training_pipeline(
        spark, f"{root}/store", f"{root}/out", raw_dir=root, log_path=f"{root}/runs", fraud_options=ROUNDS, churn_options=ROUNDS
    )
    rows = [(name, metric, float(value)) for name, step in steps.items() if step for metric, value in step.metrics.items()]
    return spark.createDataFrame(rows, "step string, metric string, value double")


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")


def _run(spark, stream, name):
    path = staged_path(spark, name)
    query = jobs.write_stream(stream, f"{path}/data", f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/data")


def stream_class_rate(spark, d):
    path = staged_path(spark, "class-rate")
    rates = jobs.class_rate(_event_stream(spark, d), "ts", F.col("event_type") == "error")
    jobs.write_windows(rates, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    rates = spark.read.parquet(f"{path}/data")
    return rates.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "positives", F.round("rate", 6).alias("rate")
    )


def stream_features(spark, d):
    events = _event_stream(spark, d).select("event_id", "value", seconds_since("ts", ORIGIN).alias("seconds"))
    out = _run(spark, jobs.stream_features(events, "value", "seconds"), "stream-features")
    return rounded(out.select("event_id", "amount_log", "time_hours", "is_night"), ["amount_log"])


def stream_drift(spark, d):
    reference, _ = halves(spark, d)
    path = staged_path(spark, "stream-drift")
    events = _event_stream(spark, d).select("value", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    query = jobs.stream_drift(events, reference, ["value", "k", "event_type"], f"{path}/data", f"{path}/checkpoint")
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/data")
    return rounded(out.select("feature", "psi", "ks_statistic", "ks_pvalue", "has_alert"), ["psi", "ks_statistic", "ks_pvalue"], 7)


QUERIES = {
    "fraud_model": fraud_model,
    "feature_importance": feature_importance,
    "training_history": training_history,
    "churn_model": churn_model,
    "anomaly_model": anomaly_model,
    "neural_anomaly_model": neural_anomaly_model,
    "neural_anomaly_history": neural_anomaly_history,
    "saved_models": saved_models,
    "tree_attribution": tree_attribution,
    "linear_attribution": linear_attribution,
    "mean_abs_attribution": mean_abs,
    "feature_store_build": feature_store_build,
    "training_pipeline": training_pipeline,
    "stream_class_rate": stream_class_rate,
    "stream_features": stream_features,
    "stream_drift": stream_drift,
}

ATTRIBUTION_SQL = (
    "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in LINE_COLUMNS) + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{w}::DOUBLE * ({c} - m_{c}) AS {c}" for c, w in WEIGHTS.items()) + " FROM lineitem, m"
)
# The first half of the month against all of it.
BOTH_SQL = f"SELECT * FROM ({HALVES_SQL}) WHERE side = 0 UNION ALL SELECT * REPLACE (1 AS side) FROM ({HALVES_SQL})"

_LABELS_SQL = """
        SELECT '{0}' AS model, CAST({1} AS INTEGER) AS label, count(*) AS n, count(*) AS same FROM {2} GROUP BY 2"""

SQL = {
    "saved_models": " UNION ALL ".join([
        _LABELS_SQL.format("trees", "l_extendedprice > 60000 AND l_discount > 0.05", "lineitem"),
        _LABELS_SQL.format("linear", "label = 0", "embeddings"), _LABELS_SQL.format("neural", "label = 0", "embeddings"),
    ]),
    "feature_store_build": f"""
        SELECT 'churn' AS dataset, "Exited" AS label, count(*) AS n, count(*) AS entities FROM ({CUSTOMERS_SQL}) GROUP BY 2
        UNION ALL
        SELECT 'fraud', CAST(label = 0 AS INTEGER), count(*), count(*)
        FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings) GROUP BY 2""",
    "linear_attribution": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in LINE_COLUMNS) + f" FROM ({ATTRIBUTION_SQL})",
    "mean_abs_attribution": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({c})), 6) AS mean_abs_shap FROM ({ATTRIBUTION_SQL})" for c in LINE_COLUMNS
    ),
    "stream_class_rate": """
        SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS positives,
               round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate
        FROM events GROUP BY 1""",
    "stream_features": f"""
        SELECT transaction_id AS event_id, round(amount_log, 6) AS amount_log, time_hours, is_night FROM ({CLEAN_FRAUD_SQL})""",
    "stream_drift": f"""
        WITH p AS ({drifting._psi_sql(BOTH_SQL, ["value", "k"], ["event_type"], 10, 7)}), k AS ({drifting._ks_sql(BOTH_SQL, ["value", "k"], 7)})
        SELECT feature, psi, ks_statistic, ks_pvalue, psi >= 0.2 OR coalesce(ks_pvalue <= 0.05, false) AS has_alert FROM p LEFT JOIN k USING (feature)""",
}
