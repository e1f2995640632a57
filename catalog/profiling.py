"""Balance, profiling and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.bands import band
from riskloom.functions.scalars import safe_ratio
from riskloom.operators import balance as ba
from riskloom.operators import features as ft
from riskloom.operators import profile as pr
from riskloom.operators import segment as sg
from riskloom.operators.evaluate import group_rates
from riskloom.sources.schemas import CHURN_FEATURES

from .tables import CLEAN_CHURN_SQL, CUSTOMER_SCORES_SQL, CUSTOMERS_SQL, LINE_COLUMNS, customer_scores, customers, is_error, rounded, table

AMOUNT_EDGES, AMOUNT_LABELS = [10, 50, 100], ["tiny", "small", "middle", "large"]
# Price per second of the stand-in devices.
RATES = [("view", 2.4e-5), ("click", 2.4e-5), ("error", 4e-3), ("signup", 4e-3), ("purchase", 2.4e-5)]
BATCH = 10_000


def class_balance(spark, d):
    rows = table(spark, d, "events").select(band("value", AMOUNT_EDGES, AMOUNT_LABELS).alias("amount_band"), is_error().alias("label"))
    return rounded(ba.class_balance(rows, "label", ["amount_band"]), ["ratio"])


def value_share(spark, d):
    rows = table(spark, d, "events").select(is_error().alias("label"))
    return rounded(ba.value_share(rows, "label", {0: "Legit", 1: "Fraud"}), ["share"])


def crosstab(spark, d):
    rows = customers(spark, d)
    return ba.crosstab(rows, "Geography", "Exited")


def crosstab_wide(spark, d):
    return ba.crosstab_wide(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def class_weights(spark, d):
    return rounded(ba.class_weights(table(spark, d, "orders"), "o_orderstatus"), ["weight"])


def weighted_rows(spark, d):
    rows = ba.with_class_weights(table(spark, d, "orders"), "o_orderstatus")
    return rounded(rows.select("o_orderkey", "o_orderstatus", "weight"), ["weight"])


def pos_weight(spark, d):
    rows = table(spark, d, "events").select(is_error().alias("label"))
    return rounded(ba.pos_weight(rows), ["pos_weight"])


def fairness(spark, d):
    rows = customer_scores(spark, d).join(customers(spark, d).select(F.col("CustomerId").alias("entity_id"), "Gender"), "entity_id")
    out = group_rates(rows, "Gender", "label", "prediction")
    return rounded(out, ["selection_rate", "true_positive_rate", "selection_rate_gap", "true_positive_rate_gap"])


def latency(spark, d):
    runs = table(spark, d, "events").select("event_type", (F.col("value") / 1000).alias("seconds"))
    out = ba.latency_summary(runs, ["event_type"], "seconds", BATCH)
    return rounded(out, ["mean_seconds", "median_seconds", "std_seconds"]).withColumn(
        "throughput_per_second", F.round("throughput_per_second", 3)
    )


def cost(spark, d):
    runs = table(spark, d, "events").select("event_type", (F.col("value") / 1000).alias("seconds"))
    summary = ba.latency_summary(runs, ["event_type"], "seconds", BATCH)
    rates = spark.createDataFrame(RATES, "event_type string, rate_per_second double")
    out = ba.cost_per_million(summary, rates, "event_type", BATCH)
    return out.select("event_type", F.round("cost_per_million", 9).alias("cost_per_million"))


def profile_numeric(spark, d):
    out = pr.profile_numeric(table(spark, d, "lineitem"), LINE_COLUMNS)
    return rounded(out, ["mean", "std", "p25", "p50", "p75", "iqr", "skew"], 5)


def profile_customers(spark, d):
    # All numeric columns that are features, as the schema tells.
    rows = ft.unpack_features(ft.churn_features(ft.clean_churn(customers(spark, d))), CHURN_FEATURES)
    numeric, _ = pr.split_by_type(rows)
    return rounded(pr.profile_numeric(rows, numeric), ["mean", "std", "min", "p25", "p50", "p75", "max", "iqr", "skew"], 4)


def skew_rank(spark, d):
    return rounded(pr.skew_rank(table(spark, d, "lineitem"), LINE_COLUMNS, top=3), ["skew"], 5)


def missing_share(spark, d):
    # Only some documents have labels.
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(pr.missing_share(rows), ["share"])


def correlation(spark, d):
    return rounded(pr.correlation_matrix(table(spark, d, "lineitem"), LINE_COLUMNS), ["r"])


def profile_any(spark, d):
    out = pr.profile_any(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    return rounded(out, ["mean", "std", "min", "p25", "p50", "p75", "max"], 4)


def density(spark, d):
    rows = table(spark, d, "events").withColumn("label", is_error())
    out = pr.density_by_class(rows, ["value"], "label", grid=50)
    return out.select("feature", "label", "position", F.round("x", 5).alias("x"), F.round("density", 8).alias("density"))


def qcut_bands(spark, d):
    return sg.qcut(customer_scores(spark, d), "probability").select("entity_id", "probability", "segment")


def _segmented(spark, d):
    raw = customers(spark, d).withColumnsRenamed({"CustomerId": "entity_id", "Exited": "label"})
    raw = raw.withColumn("balance_salary_ratio", safe_ratio("Balance", "EstimatedSalary"))
    return sg.qcut(sg.join_predictions(raw, customer_scores(spark, d)), "probability")


def segment_summary(spark, d):
    out = sg.segment_summary(
        _segmented(spark, d),
        averages={"avg_balance": "Balance", "avg_salary": "EstimatedSalary", "avg_age": "Age"},
        shares={"active_share": "IsActiveMember"},
    )
    shown = rounded(out, ["avg_balance", "avg_salary", "avg_age"], 4)
    return rounded(shown, ["churn_rate", "active_share"])


def segment_shares_text(spark, d):
    out = sg.segment_summary(_segmented(spark, d), shares={"active_share": "IsActiveMember"}, formatted=True)
    return out.select("segment", "customers", "churn_rate", "active_share")


def critical_profile(spark, d):
    critical = sg.segment_filter(_segmented(spark, d))
    return rounded(pr.profile_any(critical, ["Balance", "Age", "Gender", "Geography"]), ["mean", "std", "min", "p25", "p50", "p75", "max"], 4)


QUERIES = {
    "class_balance": class_balance,
    "value_share": value_share,
    "crosstab": crosstab,
    "crosstab_wide": crosstab_wide,
    "class_weights": class_weights,
    "with_class_weights": weighted_rows,
    "pos_weight": pos_weight,
    "group_rates": fairness,
    "latency_summary": latency,
    "cost_per_million": cost,
    "profile_numeric": profile_numeric,
    "profile_customers": profile_customers,
    "skew_rank": skew_rank,
    "missing_share": missing_share,
    "correlation_matrix": correlation,
    "profile_any": profile_any,
    "density_by_class": density,
    "qcut_bands": qcut_bands,
    "segment_summary": segment_summary,
    "segment_percent_text": segment_shares_text,
    "critical_profile": critical_profile,
}


def _numeric_sql(source: str, columns: list[str], digits: int, skew: bool = True) -> str:
    shape = f", round(skewness(v), {digits}) AS skew, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), {digits}) AS iqr" if skew else ""
    exact = (lambda e: e) if skew else (lambda e: f"round({e}, {digits})")
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(v) AS count, round(avg(v), {digits}) AS mean, round(stddev_samp(v), {digits}) AS std,
            {exact("min(v)")} AS min, round(quantile_cont(v, 0.25), {digits}) AS p25, round(quantile_cont(v, 0.5), {digits}) AS p50,
            round(quantile_cont(v, 0.75), {digits}) AS p75, {exact("max(v)")} AS max {shape}
            FROM (SELECT CAST("{c}" AS DOUBLE) AS v FROM ({source}))"""
        for c in columns
    )


def _any_sql(source: str, numeric: list[str], other: list[str], digits: int) -> str:
    parts = [f'SELECT *, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM ({_numeric_sql(source, numeric, digits, skew=False)})']
    for c in other:
        parts.append(
            f"""SELECT '{c}' AS feature, CAST(sum(n) AS BIGINT) AS count, NULL AS mean, NULL AS std, NULL AS min, NULL AS p25, NULL AS p50,
                NULL AS p75, NULL AS max, count(*) AS "unique", first(v ORDER BY n DESC, v) AS top, max(n) AS freq
                FROM (SELECT CAST("{c}" AS VARCHAR) AS v, count(*) AS n FROM ({source}) WHERE "{c}" IS NOT NULL GROUP BY 1)"""
        )
    return " UNION ALL ".join(parts)


SEGMENT_SQL = f"""
  WITH q AS (SELECT quantile_cont(probability, 0.4) AS a, quantile_cont(probability, 0.7) AS b, quantile_cont(probability, 0.9) AS c
             FROM ({CUSTOMER_SCORES_SQL}))
  SELECT s.*, CASE WHEN probability <= a THEN 'low' WHEN probability <= b THEN 'medium' WHEN probability <= c THEN 'high' ELSE 'critical' END AS segment
  FROM ({CUSTOMER_SCORES_SQL}) s, q
"""
SEGMENTED_SQL = f"""SELECT c.*, s.label, s.segment FROM ({CUSTOMERS_SQL}) c JOIN ({SEGMENT_SQL}) s ON c."CustomerId" = s.entity_id"""
STORE_NUMERIC = [
    "Age", "Tenure", "Balance", "EstimatedSalary", "NumOfProducts", "is_active_flag", "is_active_member", "has_cr_card", "CreditScore",
    "balance_salary_ratio",
]
BALANCE_SQL = """
  SELECT CASE WHEN value < 10 THEN 'tiny' WHEN value < 50 THEN 'small' WHEN value < 100 THEN 'middle' ELSE 'large' END AS amount_band,
         CAST(event_type = 'error' AS INTEGER) AS label FROM events
"""
LATENCY_SQL = f"""
  SELECT event_type, count(*) AS runs, avg(value / 1000) AS mean_seconds, quantile_cont(value / 1000, 0.5) AS median_seconds,
         stddev_pop(value / 1000) AS std_seconds, {BATCH}.0 / avg(value / 1000) AS throughput_per_second
  FROM events GROUP BY event_type
"""
RATES_SQL = ", ".join(f"('{n}', {r})" for n, r in RATES)

SQL = {
    "class_balance": f"""
        SELECT amount_band, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY amount_band), 6) AS ratio
        FROM ({BALANCE_SQL}) GROUP BY 1, 2""",
    "value_share": """
        SELECT CASE WHEN event_type = 'error' THEN 'Fraud' ELSE 'Legit' END AS label, count(*) AS count,
               round(count(*) / (SELECT count(*) FROM events), 6) AS share
        FROM events GROUP BY 1""",
    "crosstab": f"""SELECT "Geography", "Exited", count(*) AS n FROM ({CUSTOMERS_SQL}) GROUP BY 1, 2""",
    "crosstab_wide": """
        SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "o_orderstatus_F", count(*) FILTER (o_orderstatus = 'O') AS "o_orderstatus_O",
               count(*) FILTER (o_orderstatus = 'P') AS "o_orderstatus_P" FROM orders GROUP BY 1""",
    "class_weights": """
        WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
        SELECT o_orderstatus, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
    "with_class_weights": """
        WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
        SELECT o_orderkey, o_orderstatus, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight
        FROM orders JOIN c USING (o_orderstatus)""",
    "pos_weight": """
        SELECT count(*) FILTER (event_type = 'error') AS positives, count(*) FILTER (event_type <> 'error') AS negatives,
               round(count(*) FILTER (event_type <> 'error') / count(*) FILTER (event_type = 'error'), 6) AS pos_weight FROM events""",
    "group_rates": f"""
        WITH g AS (
          SELECT "Gender", count(*) AS n, avg(prediction) AS s, count(*) FILTER (prediction = 1 AND label = 1) / count(*) FILTER (label = 1) AS t
          FROM ({CUSTOMER_SCORES_SQL}) p JOIN ({CUSTOMERS_SQL}) c ON p.entity_id = c."CustomerId" GROUP BY 1)
        SELECT "Gender", n, round(s, 6) AS selection_rate, round(t, 6) AS true_positive_rate,
               round((SELECT max(s) - min(s) FROM g), 6) AS selection_rate_gap, round((SELECT max(t) - min(t) FROM g), 6) AS true_positive_rate_gap
        FROM g""",
    "latency_summary": f"""
        SELECT event_type, runs, round(mean_seconds, 6) AS mean_seconds, round(median_seconds, 6) AS median_seconds,
               round(std_seconds, 6) AS std_seconds, round(throughput_per_second, 3) AS throughput_per_second FROM ({LATENCY_SQL})""",
    "cost_per_million": f"""
        SELECT event_type, round(mean_seconds / {BATCH} * 1000000 * rate, 9) AS cost_per_million
        FROM ({LATENCY_SQL}) JOIN (VALUES {RATES_SQL}) r(event_type, rate) USING (event_type)""",
    "profile_numeric": _numeric_sql("SELECT * FROM lineitem", LINE_COLUMNS, 5),
    "profile_customers": f"""SELECT * REPLACE (round(min, 4) AS min, round(max, 4) AS max) FROM ({_numeric_sql(
        CLEAN_CHURN_SQL.replace("is_active_member", "is_active_member, " + '"IsActiveMember" AS is_active_flag', 1), STORE_NUMERIC, 4)})""",
    "skew_rank": "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(skewness({c}), 5) AS skew FROM lineitem" for c in LINE_COLUMNS)
    + ") ORDER BY abs(skew) DESC, feature LIMIT 3",
    "missing_share": """
        WITH c AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
        SELECT * FROM (
          SELECT 'doc_id' AS feature, round(1 - count(doc_id) / count(*), 6) AS share FROM c
          UNION ALL SELECT 'text', round(1 - count(text) / count(*), 6) FROM c
          UNION ALL SELECT 'lang', round(1 - count(lang) / count(*), 6) FROM c
          UNION ALL SELECT 'source', round(1 - count(source) / count(*), 6) FROM c
          UNION ALL SELECT 'n_chars', round(1 - count(n_chars) / count(*), 6) FROM c
          UNION ALL SELECT 'quality', round(1 - count(quality) / count(*), 6) FROM c
          UNION ALL SELECT 'toxic', round(1 - count(toxic) / count(*), 6) FROM c) WHERE share > 0""",
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in LINE_COLUMNS for b in LINE_COLUMNS
    ),
    "profile_any": _any_sql("SELECT * FROM orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"], 4),
    "density_by_class": """
        WITH r AS (SELECT CAST(event_type = 'error' AS INTEGER) AS label, value AS v FROM events),
        s AS (SELECT label, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS bw, min(v) AS lo, max(v) AS hi FROM r GROUP BY label),
        g AS (SELECT *, lo - 3 * bw + (hi - lo + 6 * bw) * i / 49 AS x FROM s, range(50) t(i))
        SELECT 'value' AS feature, label, CAST(i AS INTEGER) AS position, round(any_value(x), 5) AS x,
               round(sum(exp(-pow((x - v) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 8) AS density
        FROM g JOIN r USING (label) GROUP BY label, i""",
    "qcut_bands": f"SELECT entity_id, probability, segment FROM ({SEGMENT_SQL})",
    "segment_summary": f"""
        SELECT segment, count(*) AS customers, round(avg(label), 6) AS churn_rate, round(avg("IsActiveMember"), 6) AS active_share,
               round(avg("Balance"), 4) AS avg_balance, round(avg("EstimatedSalary"), 4) AS avg_salary, round(avg("Age"), 4) AS avg_age
        FROM ({SEGMENTED_SQL}) GROUP BY segment""",
    "segment_percent_text": f"""
        SELECT segment, count(*) AS customers, format('{{:.1f}}%', avg(label) * 100) AS churn_rate,
               format('{{:.1f}}%', avg("IsActiveMember") * 100) AS active_share
        FROM ({SEGMENTED_SQL}) GROUP BY segment""",
    "critical_profile": _any_sql(f"SELECT * FROM ({SEGMENTED_SQL}) WHERE segment = 'critical'", ["Balance", "Age"], ["Gender", "Geography"], 4),
}
