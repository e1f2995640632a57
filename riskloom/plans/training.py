"""Training pipeline over one session: each step takes and gives DataFrames."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate as ev
from ..operators.attribution import mean_abs_attribution, tree_attribution
from ..operators.autoencoder import Autoencoder, train_autoencoder
from ..operators.features import unpack_features
from ..operators.models import (
    AnomalyModel,
    feature_importance,
    input_names,
    save_model,
    score_batch,
    train_anomaly,
    train_churn,
    train_fraud,
    training_history,
)
from ..operators.profile import split_by_type
from ..operators.sampling import sample_n, stratified_split
from ..operators.validate import require_valid, stray_values, validate_feature_store
from ..session import stage
from ..sources.readers import read_feature_store, select_dataset
from ..sources.schemas import CHURN_FEATURES, FRAUD_FEATURES
from ..sources.sinks import log_run, write_csv_table, write_json_report
from .feature_store import build_feature_store


@dataclass
class Step:
    """Result of one training step."""

    metrics: dict
    paths: dict
    extra: dict = field(default_factory=dict)
    model: PipelineModel | AnomalyModel | Autoencoder | None = None


def _metrics(scored: DataFrame, score: str, threshold: float, out: str) -> tuple[dict, DataFrame]:
    """Point metrics and ranking metrics in one row, plus curve and class report as tables."""
    table = ev.score_counts(scored, score, "label", keep=True)
    point = ev.confusion_metrics(scored, score, "label", threshold).select("threshold", "precision", "recall", "f1")
    ranking = ev.ranking_metrics(table)
    line = {**point.first().asDict(), **ranking.first().asDict()}
    write_csv_table(ev.precision_recall_curve(table), f"{out}/precision_recall_curve")
    write_csv_table(ev.classification_report(scored), f"{out}/classification_report")
    spark = scored.sparkSession
    frame = spark.createDataFrame([tuple(line.values())], ", ".join(f"{k} double" for k in line))
    write_json_report(frame, f"{out}/metrics")
    return line, frame


def _split(store: DataFrame, schema, dataset: str) -> tuple[DataFrame, DataFrame]:
    table = stage(stratified_split(unpack_features(select_dataset(store, dataset), schema)), f"{dataset}-split")
    return table.where("split = 'train'").drop("split"), table.where("split = 'valid'").drop("split")


def supervised_step(model: PipelineModel, valid: DataFrame, out: str, threshold: float = 0.5) -> Step:
    """Score the validation rows and write model, metrics, predictions and importances."""
    scored = stage(score_batch(model, valid, threshold=threshold), "predictions")
    metrics, _ = _metrics(scored, "probability", threshold, out)
    write_csv_table(scored, f"{out}/validation_predictions")
    write_csv_table(feature_importance(model), f"{out}/feature_importance")
    save_model(model, f"{out}/model")
    names = ("metrics", "validation_predictions", "feature_importance", "model")
    return Step(metrics, {n: f"{out}/{n}" for n in names}, model=model)


def anomaly_step(train: DataFrame, valid: DataFrame, columns: list[str], out: str, linear: bool = False, **options) -> Step:
    """The neural autoencoder with its loss by epoch, or the linear one."""
    model = (train_anomaly if linear else train_autoencoder)(train, columns, **options)
    scored = stage(model.score(valid), "anomaly-scores")
    metrics, _ = _metrics(scored, "reconstruction_error", model.threshold, out)
    write_csv_table(scored, f"{out}/validation_scores")
    model.save(f"{out}/model")
    names = ["metrics", "validation_scores", "model"]
    if not linear:
        write_csv_table(training_history(model), f"{out}/training_history")
        names.append("training_history")
    return Step(metrics, {n: f"{out}/{n}" for n in names}, {"threshold": model.threshold}, model)


def attribution_step(model: PipelineModel, table: DataFrame, out: str, sample: int | None = None) -> Step:
    """Mean absolute attribution per feature over all rows, or over a sample of them."""
    rows = table if sample is None else sample_n(table, sample, ["entity_id"])
    ranked = mean_abs_attribution(tree_attribution(model, rows), input_names(model), top=None)
    write_csv_table(ranked, f"{out}/shap_importance")
    return Step({}, {"importance": f"{out}/shap_importance"}, {"sample_size": rows.count()})


def run_training_pipeline(
    spark: SparkSession,
    store_path: str,
    output_dir: str,
    raw_dir: str | None = None,
    validate: bool = True,
    skip_churn: bool = False,
    log_path: str | None = None,
    run_name: str = "fraud-train-pipeline",
    fraud_options: dict | None = None,
    churn_options: dict | None = None,
    anomaly_options: dict | None = None,
    sample: int | None = None,
) -> dict[str, Step | None]:
    """(Refresh), validate, train fraud, anomaly and churn models, attribute, log, summarise.

    With ``raw_dir`` the store is rebuilt first. A failed validation stops the run after its report
    has been written. Every row is attributed unless ``sample`` names a number of them.
    """
    if raw_dir:
        build_feature_store(spark, raw_dir, f"{output_dir}/processed", store_path)
    store = read_feature_store(spark, store_path)
    if validate:
        report = stage(validate_feature_store(store), "validation")
        write_json_report(report, f"{output_dir}/validation")
        write_csv_table(stray_values(store), f"{output_dir}/validation_strays")
        require_valid(report)

    train, valid = _split(store, FRAUD_FEATURES, "fraud")
    columns = list(FRAUD_FEATURES.names)
    steps: dict[str, Step | None] = {}
    model = train_fraud(train, columns, **(fraud_options or {}))
    steps["fraud"] = supervised_step(model, valid, f"{output_dir}/fraud/trees")
    steps["anomaly"] = anomaly_step(train, valid, columns, f"{output_dir}/fraud/anomaly", **(anomaly_options or {}))
    steps["churn"] = None
    if not skip_churn:
        churn_train, churn_valid = _split(store, CHURN_FEATURES, "churn")
        numeric, nominal = split_by_type(churn_train)
        churn = train_churn(churn_train, numeric, nominal, **(churn_options or {}))
        steps["churn"] = supervised_step(churn, churn_valid, f"{output_dir}/churn/trees")
    steps["attribution"] = attribution_step(model, train.unionByName(valid), f"{output_dir}/fraud/attribution", sample)

    done = {name: step for name, step in steps.items() if step}
    log_run(
        spark,
        log_path,
        uuid.uuid4().hex,
        run_name,
        metrics={f"{n}_{m}": s.metrics[m] for n, s in done.items() for m in ("precision", "recall", "average_precision") if m in s.metrics},
        params={
            "anomaly_threshold": done["anomaly"].extra["threshold"],
            "sample_size_attribution": done["attribution"].extra["sample_size"],
            **{f"{n}_threshold": s.metrics["threshold"] for n, s in done.items() if "threshold" in s.metrics},
        },
        artifacts={f"{n}_{k}": p for n, s in done.items() for k, p in s.paths.items()},
    )
    summary = [(n, k, str(v)) for n, s in done.items() for k, v in {**s.metrics, **s.extra, **s.paths}.items()]
    write_json_report(spark.createDataFrame(summary, "step string, key string, value string"), f"{output_dir}/summary")
    return steps
