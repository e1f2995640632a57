"""Sources, sinks, feature store and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskloom.functions.bands import credit_band, cut, tenure_band, CREDIT_EDGES, CREDIT_LABELS
from riskloom.functions.scalars import is_night, log_amount, time_hours
from riskloom.operators import features as ft
from riskloom.operators import validate as va
from riskloom.operators.balance import duplicate_count
from riskloom.operators.models import encode_categories
from riskloom.operators.profile import profile_bounds
from riskloom.plans.feature_store import balance_table
from riskloom.session import staged_path
from riskloom.sources import readers, sinks
from riskloom.sources.schemas import CHURN_FEATURES, FRAUD_FEATURES, PREDICTIONS

from .tables import (
    CLEAN_CHURN_SQL,
    CLEAN_FRAUD_SQL,
    CUSTOMERS_SQL,
    SCORES_SQL,
    TRANSACTIONS_SQL,
    customers,
    rounded,
    scores,
    table,
    transactions,
)


def _clean_transactions(spark: SparkSession, d: str) -> DataFrame:
    cleaned = transactions(spark, d).withColumns({"amount_log": log_amount("Amount"), "time_hours": time_hours("Time")})
    return cleaned.withColumn("is_night", is_night("time_hours"))


def clean_churn(spark, d):
    return rounded(ft.clean_churn(customers(spark, d)), ["balance_salary_ratio"])


def feature_store_churn(spark, d):
    packed = ft.churn_features(ft.clean_churn(customers(spark, d)))
    return rounded(ft.unpack_features(packed, CHURN_FEATURES, keep=("entity_id", "dataset", "label")), ["balance_salary_ratio"])


def feature_store_fraud(spark, d):
    packed = ft.fraud_features(_clean_transactions(spark, d))
    wide = ft.unpack_features(packed, FRAUD_FEATURES, keep=("entity_id", "dataset", "label"))
    return rounded(wide.select("entity_id", "dataset", "label", "Amount", "amount_log", "time_hours", "is_night", "V1"), ["amount_log"])


def _store(spark, d) -> DataFrame:
    return ft.union_features(ft.churn_features(ft.clean_churn(customers(spark, d))), ft.fraud_features(_clean_transactions(spark, d)))


def feature_store_union(spark, d):
    keys = F.size(F.json_object_keys("features")).cast("long")
    return _store(spark, d).select("entity_id", "dataset", "label", keys.alias("n_fields"))


STORE_SQL = f"""
  SELECT CAST(customer_id AS VARCHAR) AS entity_id, 'churn' AS dataset, label,
         9 + ("Geography" IS NOT NULL)::INT + ("CreditScore" IS NOT NULL)::INT + ("Tenure" IS NOT NULL)::INT
           + ("Gender" IS NOT NULL)::INT + 1 AS n_fields
  FROM ({CLEAN_CHURN_SQL})
  UNION ALL
  SELECT CAST(transaction_id AS VARCHAR), 'fraud', label, 4 + ("V1" IS NOT NULL)::INT FROM ({CLEAN_FRAUD_SQL})
"""


def store_roundtrip(spark, d):
    path = staged_path(spark, "store")
    sinks.write_parquet(_store(spark, d), path, ["dataset"])
    fraud = readers.read_feature_store(spark, path, "fraud")
    return fraud.select("entity_id", "dataset", F.get_json_object("features", "$.time_hours").cast("int").alias("time_hours"), "label")


def typed_store(spark, d):
    typed = ft.fraud_features(_clean_transactions(spark, d), typed=True)
    return ft.unpack_features(typed, FRAUD_FEATURES).select("entity_id", "label", "time_hours", "Amount")


def csv_roundtrip(spark, d):
    source = table(spark, d, "customer")
    path = staged_path(spark, "customer-csv")
    sinks.write_csv_table(source, path)
    return readers.read_csv_table(spark, path, source.schema)


def predictions_csv(spark, d):
    path = staged_path(spark, "predictions")
    scored = scores(spark, d).select("entity_id", "label", "probability", (F.col("probability") >= 0.5).cast("int").alias("prediction"))
    sinks.write_csv_table(scored, path)
    return readers.read_predictions(spark, path).select(*PREDICTIONS.names)


def metrics_json(spark, d):
    path = staged_path(spark, "metrics")
    report = scores(spark, d).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"),
        F.min("event_type").alias("first_type"), F.array(F.min("value"), F.max("value")).alias("bounds"),
    )
    sinks.write_json_report(report, path)
    return readers.read_metrics(spark, path)


def run_log(spark, d):
    path = staged_path(spark, "runs")
    figures = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("closed")).first()
    # A run that is repeated replaces its rows.
    for metrics in ({"rows": 0, "closed": 0}, figures.asDict()):
        sinks.log_run(spark, path, "run-1", "orders", metrics=metrics, params={"status": "F"})
    sinks.log_run(spark, path, "run-2", "orders", metrics={"rows": figures["rows"]}, artifacts={"table": "orders"})
    return sinks.read_runs(spark, path).drop("ts")


def published_table(spark, d):
    """Orders published twice, the second time whole; readers get the current version."""
    path = staged_path(spark, "published")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.publish(orders.where("o_orderstatus = 'F'"), path, ["o_orderstatus"])
    sinks.publish(orders, path, ["o_orderstatus"])
    return spark.read.parquet(sinks.published(spark, path))


def document_files(spark, d):
    path = staged_path(spark, "documents")
    # One file per document, as in a folder of notes.
    sinks.write_documents(table(spark, d, "documents").select("text"), path)
    files = readers.read_documents(spark, path, pattern="*.txt")
    return files.groupBy(F.md5("text").alias("content_md5"), F.length("text").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("files"))


def unpack_features(spark, d):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("entity_id"), "event_type", "props")
    return ft.unpack_features(events, schema, "props", keep=("entity_id", "event_type"))


def time_features(spark, d):
    cleaned = _clean_transactions(spark, d).withColumns(
        {"hour_of_day": time_hours("Time", wrap=True), "night_hour": is_night(time_hours("Time", wrap=True))}
    )
    return rounded(cleaned.select("transaction_id", "amount_log", "time_hours", "is_night", "hour_of_day", "night_hour"), ["amount_log"])


def row_id(spark, d):
    return ft.row_id(table(spark, d, "lineitem"), out="row_id", hash_name="md5")


def category_codes(spark, d):
    coded = encode_categories(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])
    return coded.select("c_custkey", "c_mktsegment", F.col("c_mktsegment_code").cast("int").alias("code"))


def cut_bands(spark, d):
    rows = customers(spark, d)
    return rows.select(
        "CustomerId",
        credit_band("CreditScore").alias("credit"),
        tenure_band("Tenure").alias("tenure"),
        cut("CreditScore", CREDIT_EDGES, CREDIT_LABELS).alias("credit_cut"),
        cut("Tenure", [3, 7], ["short", "medium", "long"]).alias("tenure_cut"),
    )


def store_balance(spark, d):
    return rounded(balance_table(ft.clean_churn(customers(spark, d)), _clean_transactions(spark, d)), ["ratio"])


def _flawed_store(spark, d) -> DataFrame:
    """Line items as a store with stray data sets, missing features, stray labels and repeated keys."""
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("entity_id"),
        F.when(flag == "A", "fraud").when(flag == "N", "churn").otherwise(flag).alias("dataset"),
        F.when(F.col("l_tax") > 0, F.col("l_tax").cast("string")).alias("features"),
        F.nullif(F.col("l_linenumber") % 4, F.lit(3)).cast("int").alias("label"),
    )


def validate_store(spark, d):
    return va.validate_feature_store(_flawed_store(spark, d))


def validate_good_store(spark, d):
    report = va.validate_feature_store(_store(spark, d))
    return report.withColumn("all_passed", va.overall(report).scalar())


def store_duplicates(spark, d):
    return duplicate_count(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def unexpected_values(spark, d):
    return va.unexpected_values(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


def validate_raw(spark, d):
    items = table(spark, d, "lineitem")
    ranges = va.range_rules(profile_bounds(items.where("l_returnflag = 'A'"), ["l_quantity", "l_extendedprice"]))
    rules = [
        va.Rule("price_non_negative", "non_negative", "l_extendedprice"),
        va.Rule("tax_present", "not_null", "l_tax"),
        va.Rule("flag_known", "in_set", "l_returnflag", values=("A", "N")),
        va.Rule("order_unique", "unique", "l_orderkey"),
        *ranges,
    ]
    return va.validate_raw(items, rules)


FLAWED_SQL = """
  SELECT l_orderkey || '-' || l_linenumber AS entity_id,
         CASE l_returnflag WHEN 'A' THEN 'fraud' WHEN 'N' THEN 'churn' ELSE l_returnflag END AS dataset,
         CASE WHEN l_tax > 0 THEN CAST(l_tax AS VARCHAR) END AS features,
         CAST(nullif(l_linenumber % 4, 3) AS INTEGER) AS label
  FROM lineitem
"""


def _report_sql(store: str) -> str:
    features = "features" if store is FLAWED_SQL else "n_fields"
    return f"""
        WITH s AS ({store}),
        c AS (SELECT count(*) AS n, count(*) - count(entity_id) AS e, count(*) - count({features}) AS f, count(*) - count(label) AS l FROM s),
        d AS (SELECT count(*) AS k, '[' || string_agg('''' || dataset || '''', ', ' ORDER BY dataset) || ']' AS t
              FROM (SELECT DISTINCT dataset FROM s WHERE dataset NOT IN ('fraud', 'churn'))),
        b AS (SELECT count(*) AS k, '[' || string_agg(coalesce(CAST(label AS VARCHAR), 'None'), ', ' ORDER BY label NULLS FIRST) || ']' AS t
              FROM (SELECT DISTINCT label FROM s WHERE coalesce(label NOT IN (0, 1), true))),
        u AS (SELECT CAST(sum(n - 1) AS BIGINT) AS k FROM (SELECT count(*) AS n FROM s GROUP BY entity_id, dataset))
        SELECT 1 AS position, 'row_count_positive' AS name, n > 0 AS success, 'row_count=' || n AS details FROM c
        UNION ALL SELECT 2, 'entity_id_not_null', e = 0, 'null_count=' || e FROM c
        UNION ALL SELECT 3, 'dataset_values_valid', k = 0, CASE WHEN k > 0 THEN 'unexpected=' || t END FROM d
        UNION ALL SELECT 4, 'features_not_null', f = 0, 'null_count=' || f FROM c
        UNION ALL SELECT 5, 'label_not_null', l = 0, 'null_count=' || l FROM c
        UNION ALL SELECT 6, 'label_values_valid', k = 0, CASE WHEN k > 0 THEN 'unexpected_labels=' || t END FROM b
        UNION ALL SELECT 7, 'entity_dataset_unique', k = 0, 'duplicate_count=' || k FROM u"""


QUERIES = {
    "clean_churn": clean_churn,
    "feature_store_churn": feature_store_churn,
    "feature_store_fraud": feature_store_fraud,
    "feature_store_union": feature_store_union,
    "feature_store_roundtrip": store_roundtrip,
    "feature_store_typed": typed_store,
    "csv_roundtrip": csv_roundtrip,
    "predictions_csv": predictions_csv,
    "metrics_json": metrics_json,
    "run_log": run_log,
    "published_table": published_table,
    "document_files": document_files,
    "unpack_features": unpack_features,
    "time_features": time_features,
    "row_id": row_id,
    "category_codes": category_codes,
    "cut_bands": cut_bands,
    "store_balance": store_balance,
    "validate_store": validate_store,
    "validate_good_store": validate_good_store,
    "duplicate_count": store_duplicates,
    "unexpected_values": unexpected_values,
    "validate_raw": validate_raw,
}

LINE_ITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
]
SQL = {
    "clean_churn": f"SELECT * REPLACE (round(balance_salary_ratio, 6) AS balance_salary_ratio) FROM ({CLEAN_CHURN_SQL})",
    "feature_store_churn": f"""
        SELECT CAST(customer_id AS VARCHAR) AS entity_id, 'churn' AS dataset, label, "Geography", "Gender", "Age", "Tenure", tenure_bucket,
               "Balance", "EstimatedSalary", "NumOfProducts", "IsActiveMember" AS is_active_flag, is_active_member, has_cr_card,
               "CreditScore", credit_score_bucket, round(balance_salary_ratio, 6) AS balance_salary_ratio
        FROM ({CLEAN_CHURN_SQL})""",
    "feature_store_fraud": f"""
        SELECT CAST(transaction_id AS VARCHAR) AS entity_id, 'fraud' AS dataset, label, "Amount", round(amount_log, 6) AS amount_log,
               time_hours, is_night, "V1"
        FROM ({CLEAN_FRAUD_SQL})""",
    "feature_store_union": f"SELECT entity_id, dataset, label, CAST(n_fields AS BIGINT) AS n_fields FROM ({STORE_SQL})",
    "feature_store_roundtrip": f"SELECT CAST(transaction_id AS VARCHAR) AS entity_id, 'fraud' AS dataset, time_hours, label FROM ({CLEAN_FRAUD_SQL})",
    "feature_store_typed": f"""SELECT CAST(transaction_id AS VARCHAR) AS entity_id, label, time_hours, "Amount" FROM ({CLEAN_FRAUD_SQL})""",
    "csv_roundtrip": "SELECT * FROM customer",
    "predictions_csv": f"SELECT entity_id, label, probability, CAST(probability >= 0.5 AS INTEGER) AS prediction FROM ({SCORES_SQL})",
    "metrics_json": """
        SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events
        UNION ALL SELECT 'mean_value', round(avg(value), 6) FROM events
        UNION ALL SELECT 'max_value', max(value) FROM events""",
    "published_table": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "run_log": """
        WITH c AS (SELECT CAST(count(*) AS VARCHAR) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR) AS f FROM orders)
        SELECT 'run-1' AS run_id, 'orders' AS run_name, 'metric' AS kind, 'rows' AS key, n AS value FROM c
        UNION ALL SELECT 'run-1', 'orders', 'metric', 'closed', f FROM c
        UNION ALL SELECT 'run-1', 'orders', 'param', 'status', 'F'
        UNION ALL SELECT 'run-2', 'orders', 'metric', 'rows', n FROM c
        UNION ALL SELECT 'run-2', 'orders', 'artifact', 'table', 'orders'""",
    "document_files": """
        SELECT md5(text || chr(10)) AS content_md5, CAST(length(text) + 1 AS BIGINT) AS n_chars, count(*) AS files
        FROM documents GROUP BY 1, 2""",
    "unpack_features": """
        SELECT CAST(event_id AS VARCHAR) AS entity_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "time_features": f"""
        SELECT transaction_id, round(amount_log, 6) AS amount_log, time_hours, is_night, CAST(time_hours % 24 AS INTEGER) AS hour_of_day,
               CAST(time_hours % 24 < 6 AS INTEGER) AS night_hour
        FROM ({CLEAN_FRAUD_SQL})""",
    "row_id": f"""
        SELECT *, md5({" || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in LINE_ITEM)}) || '-' || (row_number() OVER (PARTITION BY {", ".join(LINE_ITEM)}) - 1) AS row_id
        FROM lineitem""",
    "category_codes": """
        WITH c AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer GROUP BY 1)
        SELECT c_custkey, c_mktsegment, CAST(code AS INTEGER) AS code FROM customer JOIN c USING (c_mktsegment)""",
    "cut_bands": f"""
        SELECT customer_id AS "CustomerId", credit_score_bucket AS credit, tenure_bucket AS tenure,
               CASE WHEN "CreditScore" IS NOT NULL THEN credit_score_bucket END AS credit_cut,
               CASE WHEN "Tenure" IS NOT NULL THEN tenure_bucket END AS tenure_cut
        FROM ({CLEAN_CHURN_SQL})""",
    "store_balance": f"""
        SELECT dataset, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY dataset), 6) AS ratio
        FROM ({STORE_SQL}) GROUP BY dataset, label""",
    "validate_store": _report_sql(FLAWED_SQL),
    "validate_good_store": f"SELECT *, (SELECT bool_and(success) FROM ({_report_sql(STORE_SQL)})) AS all_passed FROM ({_report_sql(STORE_SQL)})",
    "duplicate_count": """
        SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "unexpected_values": """
        SELECT o_orderpriority, count(*) AS n FROM orders WHERE coalesce(o_orderpriority NOT IN ('1-URGENT', '2-HIGH'), true) GROUP BY 1""",
    "validate_raw": """
        WITH p AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS e0, max(l_extendedprice) AS e1
                   FROM lineitem WHERE l_returnflag = 'A'),
        v AS (
          SELECT 'price_non_negative' AS name, count(*) FILTER (l_extendedprice < 0) AS violations FROM lineitem
          UNION ALL SELECT 'tax_present', count(*) FILTER (l_tax IS NULL) FROM lineitem
          UNION ALL SELECT 'flag_known', count(*) FILTER (coalesce(l_returnflag NOT IN ('A', 'N'), true)) FROM lineitem
          UNION ALL SELECT 'order_unique', count(*) - count(DISTINCT l_orderkey) FROM lineitem
          UNION ALL SELECT 'l_quantity_in_range', count(*) FILTER (l_quantity < q0 OR l_quantity > q1) FROM lineitem, p
          UNION ALL SELECT 'l_extendedprice_in_range', count(*) FILTER (l_extendedprice < e0 OR l_extendedprice > e1) FROM lineitem, p)
        SELECT name, violations, violations = 0 AS success FROM v""",
}
