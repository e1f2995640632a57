"""The test tables in the roles of transactions, customers and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.scalars import seconds_since
from riskloom.sources.schemas import COMPONENTS

ACTIVE_SINCE = "2001-01-01"
ORIGIN = "2024-01-01 00:00:00"
MIDDLE = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_error() -> F.Column:
    return (F.col("event_type") == "error").cast("int")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as card transactions: amount, seconds since the start, one known component."""
    known = {"V1": F.get_json_object("props", "$.k").cast("double")}
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaction_id"),
        seconds_since("ts", ORIGIN).alias("Time"),
        F.col("value").alias("Amount"),
        is_error().alias("label"),
        *[known.get(v, F.lit(None).cast("double")).alias(v) for v in COMPONENTS],
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with order totals in the columns of the raw churn table."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.max("o_totalprice").alias("largest"),
        F.min("o_orderdate").alias("first"),
        F.max("o_orderdate").alias("last"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    active = F.coalesce(F.col("last") >= F.lit(ACTIVE_SINCE).cast("timestamp_ntz"), F.lit(False))
    return (
        table(spark, sf_dir, "customer")
        .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("int").alias("RowNumber"),
            F.col("c_custkey").alias("CustomerId"),
            F.col("c_name").alias("Surname"),
            (F.lit(350) + F.floor(F.col("largest") / 1000)).cast("int").alias("CreditScore"),
            F.col("n_name").alias("Geography"),
            F.col("c_mktsegment").alias("Gender"),
            (F.lit(18) + F.col("c_custkey") % 60).cast("int").alias("Age"),
            (F.year("last") - F.year("first")).cast("int").alias("Tenure"),
            F.col("c_acctbal").alias("Balance"),
            F.coalesce("n", F.lit(0)).cast("int").alias("NumOfProducts"),
            (F.col("c_acctbal") >= 0).cast("int").alias("HasCrCard"),
            active.cast("int").alias("IsActiveMember"),
            F.coalesce("total", F.lit(0.0)).alias("EstimatedSalary"),
            (~active).cast("int").alias("Exited"),
        )
    )


CUSTOMERS_SQL = f"""
  SELECT c_custkey AS "CustomerId", CAST(350 + floor(o.largest / 1000) AS INTEGER) AS "CreditScore",
         n_name AS "Geography", c_mktsegment AS "Gender", CAST(18 + c_custkey % 60 AS INTEGER) AS "Age",
         CAST(year(o.last) - year(o.first) AS INTEGER) AS "Tenure", c_acctbal AS "Balance",
         CAST(coalesce(o.n, 0) AS INTEGER) AS "NumOfProducts", CAST(c_acctbal >= 0 AS INTEGER) AS "HasCrCard",
         CAST(coalesce(o.last >= TIMESTAMP '{ACTIVE_SINCE}', false) AS INTEGER) AS "IsActiveMember",
         coalesce(o.total, 0.0) AS "EstimatedSalary",
         CAST(NOT coalesce(o.last >= TIMESTAMP '{ACTIVE_SINCE}', false) AS INTEGER) AS "Exited"
  FROM customer
  LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n, max(o_totalprice) AS largest,
                    min(o_orderdate) AS first, max(o_orderdate) AS last
             FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
"""

CLEAN_CHURN_SQL = f"""
  SELECT "CustomerId" AS customer_id, "CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance",
         "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary", "Exited" AS label,
         "IsActiveMember" AS is_active_member, "HasCrCard" AS has_cr_card,
         CASE WHEN "EstimatedSalary" > 0 THEN "Balance" / "EstimatedSalary" ELSE 0.0 END AS balance_salary_ratio,
         CASE WHEN "CreditScore" >= 750 THEN 'excellent' WHEN "CreditScore" >= 650 THEN 'good'
              WHEN "CreditScore" >= 550 THEN 'fair' ELSE 'poor' END AS credit_score_bucket,
         CASE WHEN "Tenure" < 3 THEN 'short' WHEN "Tenure" < 7 THEN 'medium' ELSE 'long' END AS tenure_bucket
  FROM ({CUSTOMERS_SQL})
"""

TRANSACTIONS_SQL = f"""
  SELECT event_id AS transaction_id, epoch_us(ts) / 1e6 - epoch(TIMESTAMP '{ORIGIN}') AS "Time", value AS "Amount",
         CAST(event_type = 'error' AS INTEGER) AS label, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS "V1"
  FROM events
"""

CLEAN_FRAUD_SQL = f"""
  SELECT *, ln(1 + "Amount") AS amount_log, CAST(floor("Time" / 3600) AS INTEGER) AS time_hours,
         CAST(floor("Time" / 3600) BETWEEN 0 AND 5 AS INTEGER) AS is_night
  FROM ({TRANSACTIONS_SQL})
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a fixed logistic score of their value; four decimals give many ties."""
    score = F.round(1 / (1 + F.exp(-(F.col("value") - 50) / 25)), 4)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("entity_id"), "event_type", "value", is_error().alias("label"), score.alias("probability")
    )


SCORES_SQL = """
  SELECT CAST(event_id AS VARCHAR) AS entity_id, event_type, value, CAST(event_type = 'error' AS INTEGER) AS label,
         round(1 / (1 + exp(-(value - 50) / 25)), 4) AS probability
  FROM events
"""


def customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction table for customers: a fixed logistic of balance and number of orders."""
    margin = F.col("Balance") / 5000 - F.col("NumOfProducts") / 10
    p = F.round(1 / (1 + F.exp(-margin)), 6)
    return customers(spark, sf_dir).select(
        F.col("CustomerId").alias("entity_id"), F.col("Exited").alias("label"), p.alias("probability"), (p >= 0.5).cast("int").alias("prediction")
    )


CUSTOMER_SCORES_SQL = f"""
  SELECT "CustomerId" AS entity_id, "Exited" AS label, round(1 / (1 + exp(-("Balance" / 5000 - "NumOfProducts" / 10))), 6) AS probability,
         CAST(round(1 / (1 + exp(-("Balance" / 5000 - "NumOfProducts" / 10))), 6) >= 0.5 AS INTEGER) AS prediction
  FROM ({CUSTOMERS_SQL})
"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events before and from the middle of the month, with a number from their properties."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("event_time"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    middle = F.lit(MIDDLE).cast("timestamp_ntz")
    return events.where(F.col("event_time") < middle), events.where(F.col("event_time") >= middle)


HALVES_SQL = f"""
  SELECT event_id, ts AS event_time, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN ts < TIMESTAMP '{MIDDLE}' THEN 0 ELSE 1 END AS side
  FROM events
"""

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
