"""Command line: ``python -m riskloom <job> --help``. Paths may be any Spark can reach."""

from __future__ import annotations

import argparse

from .operators.features import unpack_features
from .operators.validate import require_valid, validate_feature_store
from .plans.drift_report import drift_report
from .plans.evaluation import evaluate_scores, write_evaluation
from .plans.feature_store import build_feature_store
from .plans.training import run_training_pipeline
from .session import build_session, stage
from .sources.readers import read_feature_store, read_metrics, read_predictions
from .sources.schemas import CHURN_FEATURES, FRAUD_FEATURES
from .sources.sinks import write_json_report

SCHEMAS = {"churn": CHURN_FEATURES, "fraud": FRAUD_FEATURES}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="riskloom", description="Risk analytics jobs on Spark.")
    jobs = parser.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("build-store", help="raw CSV tables to cleaned tables and feature store")
    job.add_argument("--raw-dir", required=True)
    job.add_argument("--processed-dir", required=True)
    job.add_argument("--feature-store", required=True)
    job.add_argument("--bias-report")

    job = jobs.add_parser("validate", help="check a feature store, write the report, fail on a broken check")
    job.add_argument("--feature-store", required=True)
    job.add_argument("--report", required=True)

    job = jobs.add_parser("train", help="validate, train, evaluate, attribute, log")
    job.add_argument("--feature-store", required=True)
    job.add_argument("--output-dir", required=True)
    job.add_argument("--raw-dir", help="rebuild the store from here first")
    job.add_argument("--run-log")
    job.add_argument("--run-name", default="fraud-train-pipeline")
    job.add_argument("--skip-churn", action="store_true")
    job.add_argument("--skip-validation", action="store_true")
    job.add_argument("--rounds", type=int, default=600)
    job.add_argument("--sample-size", type=int, help="rows for the attribution; all without it")

    job = jobs.add_parser("evaluate", help="sweep, calibration and curve of a CSV of scores")
    job.add_argument("--scores", required=True)
    job.add_argument("--output-dir", required=True)
    job.add_argument("--anomaly", action="store_true", help="scores are reconstruction errors")
    job.add_argument("--n-bins", type=int, default=10)
    job.add_argument("--threshold-steps", type=int, default=15)

    job = jobs.add_parser("drift", help="compare one data set of two feature stores")
    job.add_argument("--reference", required=True)
    job.add_argument("--current", required=True)
    job.add_argument("--dataset", choices=sorted(SCHEMAS), required=True)
    job.add_argument("--output-dir", required=True)
    job.add_argument("--baseline-metrics")
    job.add_argument("--current-metrics")
    job.add_argument("--psi-threshold", type=float, default=0.2)
    job.add_argument("--p-threshold", type=float, default=0.05)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session()
    if args.job == "build-store":
        build_feature_store(spark, args.raw_dir, args.processed_dir, args.feature_store, args.bias_report)
    elif args.job == "validate":
        report = stage(validate_feature_store(read_feature_store(spark, args.feature_store)), "validation")
        write_json_report(report, args.report)
        require_valid(report)
    elif args.job == "train":
        run_training_pipeline(
            spark, args.feature_store, args.output_dir, raw_dir=args.raw_dir, validate=not args.skip_validation,
            skip_churn=args.skip_churn, log_path=args.run_log, run_name=args.run_name,
            fraud_options={"rounds": args.rounds}, churn_options={"rounds": args.rounds}, sample=args.sample_size,
        )
    elif args.job == "evaluate":
        scores = read_predictions(spark, args.scores, args.anomaly)
        column = "reconstruction_error" if args.anomaly else "probability"
        write_evaluation(evaluate_scores(scores, column, anomaly=args.anomaly, steps=args.threshold_steps, bins=args.n_bins), args.output_dir)
    else:
        reference, current = (
            unpack_features(read_feature_store(spark, path, args.dataset), SCHEMAS[args.dataset], keep=())
            for path in (args.reference, args.current)
        )
        metrics = [read_metrics(spark, path) if path else None for path in (args.baseline_metrics, args.current_metrics)]
        report = drift_report(
            reference, current, psi_threshold=args.psi_threshold, p_threshold=args.p_threshold,
            baseline_metrics=metrics[0], current_metrics=metrics[1],
        )
        write_json_report(report.features, f"{args.output_dir}/features")
        write_json_report(report.header, f"{args.output_dir}/header")
        if report.metrics is not None:
            write_json_report(report.metrics, f"{args.output_dir}/metrics")


if __name__ == "__main__":
    main()
