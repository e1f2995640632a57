"""Drift of data and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import drift as dr
from riskloom.operators.evaluate import linspace
from riskloom.plans.drift_report import drift_report

from .tables import HALVES_SQL, halves, rounded, table

NUMERIC, CATEGORICAL = ["value", "k", "user_id"], ["event_type"]
SPLIT_DATE = "1999-01-01"


def _items(spark, d):
    items = table(spark, d, "lineitem")
    early = F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz")
    return items.where(early), items.where(~early)


def psi_numeric(spark, d):
    reference, current = halves(spark, d)
    return rounded(dr.psi(reference, current, numeric=NUMERIC), ["psi"], 8)


def psi_lineitem(spark, d):
    reference, current = _items(spark, d)
    return rounded(dr.psi(reference, current, numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], bins=20), ["psi"], 8)


def psi_categorical(spark, d):
    reference, current = _items(spark, d)
    return rounded(dr.psi(reference, current, categorical=["l_returnflag", "l_linestatus"]), ["psi"], 8)


def ks_two_sample(spark, d):
    reference, current = halves(spark, d)
    return rounded(dr.ks_two_sample(reference, current, NUMERIC), ["ks_statistic", "ks_pvalue"], 8)


def ks_lineitem(spark, d):
    reference, current = _items(spark, d)
    return rounded(dr.ks_two_sample(reference, current, ["l_quantity", "l_extendedprice"]), ["ks_statistic", "ks_pvalue"], 8)


def category_counts(spark, d):
    reference, current = _items(spark, d)
    return dr.category_counts(reference, current, "l_returnflag")


def _metrics(rows):
    return rows.groupBy(F.col("event_type").alias("metric")).agg((F.avg("value") / 100).alias("value"))


def metric_drift(spark, d):
    reference, current = halves(spark, d)
    tolerances = spark.createDataFrame([("click", 0.5), ("view", 0.0)], "metric string, tolerance double")
    out = dr.performance_drift(
        _metrics(reference.where("event_type <> 'signup'")), _metrics(current.where("event_type <> 'error'")), tolerances
    )
    return rounded(out, ["baseline", "current", "delta"])


def drift_features(spark, d):
    reference, current = halves(spark, d)
    shifted = current.withColumn("value", F.col("value") * 1.2)
    out = dr.feature_drift(reference, shifted, [*NUMERIC, *CATEGORICAL])
    return rounded(out, ["psi", "ks_statistic", "ks_pvalue"], 7).drop("alerts")


def drift_common_columns(spark, d):
    # Without a list the features are the columns that both sides have.
    reference, current = _items(spark, d)
    left = reference.select("l_quantity", "l_returnflag", "l_tax", "l_suppkey")
    right = current.select("l_tax", "l_returnflag", "l_quantity", "l_partkey")
    out = dr.feature_drift(left, right)
    return rounded(out, ["psi", "ks_statistic", "ks_pvalue"], 7).drop("alerts")


def drift_header(spark, d):
    reference, current = halves(spark, d)
    shifted = current.withColumn("value", F.col("value") * 1.2)
    metrics = _metrics(reference)
    report = drift_report(reference, shifted, ["value", "event_type"], baseline_metrics=metrics, current_metrics=metrics)
    return report.header.drop("generated_at")


QUERIES = {
    "psi_numeric": psi_numeric,
    "psi_numeric_lineitem": psi_lineitem,
    "psi_categorical": psi_categorical,
    "ks_two_sample": ks_two_sample,
    "ks_two_sample_lineitem": ks_lineitem,
    "category_counts": category_counts,
    "metric_drift": metric_drift,
    "drift_report": drift_features,
    "drift_common_columns": drift_common_columns,
    "drift_header": drift_header,
}

ITEMS_SQL = f"SELECT *, CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_DATE}' THEN 0 ELSE 1 END AS side FROM lineitem"


def _psi_of(bins: str) -> str:
    """PSI from a query of (side, bin)."""
    return f"""
        (SELECT sum((p - q) * ln((p + 1e-6) / (q + 1e-6))) FROM (
           SELECT r / (sum(r) OVER () + 1e-6) AS p, c / (sum(c) OVER () + 1e-6) AS q FROM (
             SELECT count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM ({bins}) GROUP BY bin)))"""


def _numeric_bins(source: str, column: str, n: int) -> str:
    probs = "[" + ", ".join(f"'{p!r}'::DOUBLE" for p in linspace(0.0, 1.0, n + 1)[1:-1]) + "]"
    return f"""
        SELECT side, len(list_filter(list_distinct(q), lambda x: x <= {column})) AS bin
        FROM ({source}), (SELECT quantile_cont({column}, {probs}) AS q FROM ({source}) WHERE side = 0)"""


def _psi_sql(source: str, numeric: list[str], categorical: list[str], n: int, digits: int) -> str:
    parts = [f"SELECT '{c}' AS feature, round({_psi_of(_numeric_bins(source, c, n))}, {digits}) AS psi" for c in numeric]
    parts += [f"SELECT '{c}' AS feature, round({_psi_of(f'SELECT side, {c} AS bin FROM ({source})')}, {digits}) AS psi" for c in categorical]
    return " UNION ALL ".join(parts)


SERIES = " + ".join(f"{2.0 * (-1) ** (k - 1)} * exp({-2.0 * k * k} * l * l)" for k in range(1, 101))


def _ks_sql(source: str, columns: list[str], digits: int) -> str:
    parts = [
        f"""SELECT '{c}' AS feature, max(abs(fr / nr - fc / nc)) AS d, any_value(nr) AS nr, any_value(nc) AS nc FROM (
              SELECT sum(r) OVER w AS fr, sum(c) OVER w AS fc, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM (
                SELECT {c} AS v, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM ({source}) GROUP BY 1)
              WINDOW w AS (ORDER BY v))"""
        for c in columns
    ]
    return f"""
        SELECT feature, round(d, {digits}) AS ks_statistic,
               round(CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, {SERIES})) END, {digits}) AS ks_pvalue
        FROM (SELECT *, (sqrt(nr * nc / (nr + nc)) + 0.12 + 0.11 / sqrt(nr * nc / (nr + nc))) * d AS l FROM ({" UNION ALL ".join(parts)}))"""


SHIFTED_SQL = f"SELECT * REPLACE (CASE WHEN side = 1 THEN value * 1.2 ELSE value END AS value) FROM ({HALVES_SQL})"


def _report_sql(source: str, numeric: list[str], categorical: list[str]) -> str:
    return f"""
    WITH p AS ({_psi_sql(source, numeric, categorical, 10, 7)}), k AS ({_ks_sql(source, numeric, 7)}),
    a AS (SELECT feature, psi, ks_statistic, ks_pvalue,
                 CASE WHEN psi >= 0.2 THEN 'PSI ' || format('{{:.3f}}', psi) || ' >= threshold 0.2' END AS x,
                 CASE WHEN ks_pvalue <= 0.05 THEN 'KS p-value ' || format('{{:.3f}}', ks_pvalue) || ' <= threshold 0.05' END AS y
          FROM p LEFT JOIN k USING (feature))
    SELECT feature, psi, ks_statistic, ks_pvalue, x IS NOT NULL OR y IS NOT NULL AS has_alert,
           CASE WHEN x IS NULL AND y IS NULL THEN 'OK' ELSE concat_ws(', ', x, y) END AS alert_text
    FROM a"""


REPORT_SQL = _report_sql(SHIFTED_SQL, NUMERIC, CATEGORICAL)

SQL = {
    "psi_numeric": _psi_sql(HALVES_SQL, NUMERIC, [], 10, 8),
    "psi_numeric_lineitem": _psi_sql(ITEMS_SQL, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], [], 20, 8),
    "psi_categorical": _psi_sql(ITEMS_SQL, [], ["l_returnflag", "l_linestatus"], 10, 8),
    "ks_two_sample": _ks_sql(HALVES_SQL, NUMERIC, 8),
    "ks_two_sample_lineitem": _ks_sql(ITEMS_SQL, ["l_quantity", "l_extendedprice"], 8),
    "category_counts": f"""
        SELECT l_returnflag, count(*) FILTER (side = 0) AS reference, count(*) FILTER (side = 1) AS current FROM ({ITEMS_SQL}) GROUP BY 1""",
    "metric_drift": f"""
        WITH b AS (SELECT event_type AS metric, avg(value) / 100 AS v FROM ({HALVES_SQL}) WHERE side = 0 AND event_type <> 'signup' GROUP BY 1),
        c AS (SELECT event_type AS metric, avg(value) / 100 AS v FROM ({HALVES_SQL}) WHERE side = 1 AND event_type <> 'error' GROUP BY 1),
        j AS (SELECT metric, b.v AS baseline, c.v AS current, coalesce(t, 0.02) AS tolerance
              FROM b FULL JOIN c USING (metric) LEFT JOIN (VALUES ('click', 0.5::DOUBLE), ('view', 0.0::DOUBLE)) t(metric, t) USING (metric))
        SELECT metric, round(baseline, 6) AS baseline, round(current, 6) AS current, round(current - baseline, 6) AS delta,
               CAST(tolerance AS DOUBLE) AS tolerance, coalesce(abs(current - baseline) > tolerance, true) AS alert FROM j""",
    "drift_report": REPORT_SQL,
    "drift_common_columns": _report_sql(ITEMS_SQL, ["l_quantity", "l_tax"], ["l_returnflag"]),
    "drift_header": f"""
        SELECT count(*) FILTER (side = 0) AS reference_rows, min(event_time) FILTER (side = 0) AS reference_time_min,
               max(event_time) FILTER (side = 0) AS reference_time_max, count(*) FILTER (side = 1) AS current_rows,
               min(event_time) FILTER (side = 1) AS current_time_min, max(event_time) FILTER (side = 1) AS current_time_max,
               (SELECT bool_or(has_alert) FROM ({REPORT_SQL}) WHERE feature IN ('value', 'event_type')) AS data_alert, false AS performance_alert,
               0.2::DOUBLE AS psi_threshold, 0.05::DOUBLE AS ks_pvalue_threshold,
               (SELECT bool_or(has_alert) FROM ({REPORT_SQL}) WHERE feature IN ('value', 'event_type')) AS has_alerts
        FROM ({HALVES_SQL})""",
}
