"""Build of the feature store from the raw CSV tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.balance import balance_map, class_balance
from ..operators.features import churn_features, clean_churn, clean_fraud, fraud_features, union_features
from ..sources.readers import read_csv_table
from ..sources.schemas import CHURN_RAW, FRAUD_RAW
from ..sources.sinks import publish, write_json_report, write_parquet

# Where the raw files lie below the raw folder.
CHURN_FILE = "bank_churn/Churn_Modelling.csv"
FRAUD_FILE = "creditcard_fraud/creditcard.csv"


@dataclass
class StorePaths:
    churn: str
    fraud: str
    store: str
    report: str


def build_feature_store(
    spark: SparkSession, raw_dir: str, processed_dir: str, store_path: str, report_path: str | None = None, typed: bool = False,
    versioned: bool = False,
) -> StorePaths:
    """Read the raw tables, write the cleaned tables, the store (by data set) and the balance report.

    Each CSV is read once: features and balance are derived from the cleaned Parquet tables. A ``versioned`` store is
    published: the old one stays readable until the new one is complete.
    """
    if typed and versioned:
        raise ValueError("a store of typed features has a folder per data set and cannot be published as one table")
    paths = StorePaths(
        f"{processed_dir}/bank_churn", f"{processed_dir}/creditcard_fraud", store_path, report_path or f"{processed_dir}/data_bias_report"
    )
    write_parquet(clean_churn(read_csv_table(spark, f"{raw_dir}/{CHURN_FILE}", CHURN_RAW)), paths.churn)
    write_parquet(clean_fraud(read_csv_table(spark, f"{raw_dir}/{FRAUD_FILE}", FRAUD_RAW)), paths.fraud)
    churn, fraud = spark.read.parquet(paths.churn), spark.read.parquet(paths.fraud)
    if typed:
        # Two structs do not share a column; each data set gets its own directory.
        write_parquet(churn_features(churn, typed=True), f"{store_path}/dataset=churn")
        write_parquet(fraud_features(fraud, typed=True), f"{store_path}/dataset=fraud")
    else:
        features = union_features(churn_features(churn), fraud_features(fraud))
        (publish if versioned else write_parquet)(features, store_path, ["dataset"])
    write_json_report(balance_report(churn, fraud), paths.report)
    return paths


def labels_of(churn: DataFrame, fraud: DataFrame) -> DataFrame:
    return churn.select(F.lit("churn").alias("dataset"), "label").unionByName(fraud.select(F.lit("fraud").alias("dataset"), "label"))


def balance_report(churn: DataFrame, fraud: DataFrame) -> DataFrame:
    """Share of each label per data set, nested: one row per data set."""
    return balance_map(labels_of(churn, fraud))


def balance_table(churn: DataFrame, fraud: DataFrame) -> DataFrame:
    return class_balance(labels_of(churn, fraud), "label", ["dataset"])
