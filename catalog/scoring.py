"""Evaluation of scores, scaling, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.scalars import threshold_predict
from riskloom.operators import evaluate as ev
from riskloom.operators import sampling as sa
from riskloom.operators import scaling as sc
from riskloom.plans.evaluation import evaluate_scores

from .tables import LINE_COLUMNS, SCORES_SQL, rounded, scores, table

SEED = 42


def _table(spark, d, score="probability", keep=False):
    return ev.score_counts(scores(spark, d), score, "label", keep)


def pr_curve(spark, d):
    return rounded(ev.precision_recall_curve(_table(spark, d)), ["precision", "recall"])


def roc_auc(spark, d):
    return rounded(ev.roc_auc(_table(spark, d)), ["roc_auc"], 8)


def average_precision(spark, d):
    return rounded(ev.average_precision(_table(spark, d)), ["average_precision"], 8)


SWEEP = ["threshold", "precision", "recall", "f1", "average_precision"]


def threshold_sweep(spark, d):
    out = ev.threshold_sweep(_table(spark, d), ev.score_thresholds())
    return rounded(out, SWEEP).drop("position")


def percentile_sweep(spark, d):
    report = evaluate_scores(scores(spark, d), "value", anomaly=True)
    return rounded(report.sweep, [*SWEEP, "percentile"]).drop("position")


def best_threshold(spark, d):
    out = evaluate_scores(scores(spark, d)).best
    return rounded(out, SWEEP).drop("position")


def calibration(spark, d):
    out = ev.calibration_curve(_table(spark, d))
    return rounded(out, ["mean_score", "positive_rate"])


def calibration_scaled(spark, d):
    out = evaluate_scores(scores(spark, d), "value", anomaly=True).calibration
    return rounded(out, ["mean_score", "positive_rate"])


def confusion(spark, d):
    out = ev.confusion_metrics(scores(spark, d), "probability", "label", 0.5)
    return rounded(out, ["precision", "recall", "f1"])


def class_report(spark, d):
    rows = scores(spark, d).withColumn("prediction", threshold_predict("probability", 0.5))
    return rounded(ev.classification_report(rows), ["precision", "recall", "f1"])


def score_percentile(spark, d):
    legit = scores(spark, d).where("label = 0")
    found = ev.score_percentile(legit, "value", [50.0, 97.5, 99.9])
    rows = scores(spark, d)
    flags = [F.count_if(threshold_predict("value", v) == 1).alias(f"above_{i}") for i, v in enumerate(found.values())]
    values = [F.lit(round(v, 6)).alias(f"limit_{i}") for i, v in enumerate(found.values())]
    return rows.agg(*flags).select("*", *values)


def scale_min_max(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = sc.min_max_scale(items, ["l_extendedprice", "l_quantity"])
    return rounded(out, ["l_extendedprice", "l_quantity"])


def scale_standard(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *LINE_COLUMNS)
    out = sc.standard_scale(items, LINE_COLUMNS, fit_on=F.col("l_returnflag") == "N")
    return rounded(out, LINE_COLUMNS)


def perturb(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = sc.perturb_numeric(orders, ["o_totalprice"], ["o_orderkey"], strength=0.5, seed=SEED, method="md5")
    return rounded(out, ["o_totalprice"], 3)


def split(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sa.stratified_split(orders, "o_orderstatus", ["o_orderkey"], 0.2, SEED, "md5")


def split_fast(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    parts = sa.stratified_split(orders, "o_orderstatus", ["o_orderkey"], 0.2, SEED)
    return parts.groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"))


def sample_n(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sa.sample_n(orders, 500, ["o_orderkey"], SEED, "md5")


def sample_large(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sa.sample_n(orders, 12_000, ["o_orderkey"], SEED, "md5")


def sample_fraction(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    loose = sa.sample_fraction(orders, 0.3, ["o_orderkey"], SEED, "md5").withColumn("kind", F.lit("hash"))
    exact = sa.sample_fraction(orders, 0.3, ["o_orderkey"], SEED, "md5", exact=True).withColumn("kind", F.lit("exact"))
    return loose.unionByName(exact)


def complement(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    reference, current = sa.complement_split(orders, 0.5, ["o_orderkey"], SEED, "md5")
    return reference.withColumn("side", F.lit("reference")).unionByName(current.withColumn("side", F.lit("current")))


QUERIES = {
    "pr_curve": pr_curve,
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "threshold_sweep": threshold_sweep,
    "percentile_sweep": percentile_sweep,
    "best_threshold": best_threshold,
    "calibration": calibration,
    "calibration_scaled": calibration_scaled,
    "confusion": confusion,
    "class_report": class_report,
    "score_percentile": score_percentile,
    "scale_min_max": scale_min_max,
    "scale_standard": scale_standard,
    "perturb_numeric": perturb,
    "stratified_split": split,
    "split_counts": split_fast,
    "sample_n": sample_n,
    "sample_n_large": sample_large,
    "sample_fraction": sample_fraction,
    "complement_split": complement,
}

GROUPED_SQL = f"""
  SELECT probability, sum(label) AS pos, count(*) - sum(label) AS neg FROM ({SCORES_SQL}) GROUP BY probability
"""
RUNNING_SQL = f"""
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM ({GROUPED_SQL}) WINDOW w AS (ORDER BY probability DESC)
"""
AP_SQL = f"SELECT sum(pos / p * tp / (tp + fp)) AS ap FROM ({RUNNING_SQL})"


def _sweep_sql(steps: str, score: str, ap: str, extra: str = "") -> str:
    return f"""
        WITH t AS ({steps}),
        c AS (SELECT i, any_value(t) AS t{extra}, count(*) FILTER ({score} >= t AND label = 1) AS tp, count(*) FILTER ({score} >= t AND label = 0) AS fp,
                     count(*) FILTER (label = 1) AS p
              FROM ({SCORES_SQL}), t GROUP BY i),
        m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, tp / p AS re FROM c)
        SELECT i, round(t, 6) AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall,
               round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1,
               round(({ap}), 6) AS average_precision{", round(percentile, 6) AS percentile" if extra else ""}
        FROM m"""


LINEAR_STEPS = "SELECT i, CASE WHEN i = 14 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 14) END AS t FROM range(15) r(i)"


def _doubles(values) -> str:
    return "[" + ", ".join(f"'{float(v)!r}'::DOUBLE" for v in values) + "]"


QUANTILE_STEPS = _doubles(p / 100 for p in ev.linspace(60.0, 99.9, 15))
TENTHS = _doubles(ev.linspace(0.0, 1.0, 11)[1:-1])
PERCENT_STEPS = f"""
  SELECT i, 60.0::DOUBLE + i * 2.85::DOUBLE AS percentile, (SELECT quantile_cont(value, {QUANTILE_STEPS}) FROM events)[i + 1] AS t FROM range(15) r(i)
"""
VALUE_AP_SQL = """
  SELECT sum(pos / p * tp / (tp + fp)) FROM (
    SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p
    FROM (SELECT value, count(*) FILTER (event_type = 'error') AS pos, count(*) FILTER (event_type <> 'error') AS neg FROM events GROUP BY value)
    WINDOW w AS (ORDER BY value DESC))
"""


def _calibration_sql(score: str, shown: str) -> str:
    return f"""
        WITH s AS ({SCORES_SQL}),
        e AS (SELECT quantile_cont({score}, {TENTHS}) AS q, min({score}) AS lo, max({score}) AS hi FROM s),
        b AS (SELECT len(list_filter(q, lambda x: x < {score})) AS bin, label, {shown} AS v FROM s, e)
        SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(v), 6) AS mean_score, round(avg(label), 6) AS positive_rate FROM b GROUP BY bin"""


def _hash_sql(key: str, seed: int = SEED) -> str:
    return f"('0x' || substr(md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}')), 1, 15))::BIGINT"


def _noise_seed(i: int) -> int:
    return SEED * 1_000_003 + i


SQL = {
    "pr_curve": f"""
        SELECT probability AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM ({RUNNING_SQL})
        UNION ALL SELECT NULL, 1.0, 0.0""",
    "roc_auc": f"SELECT round(sum(pos * (n - fp + neg / 2)) / (any_value(p) * any_value(n)), 8) AS roc_auc FROM ({RUNNING_SQL})",
    "average_precision": f"SELECT round(ap, 8) AS average_precision FROM ({AP_SQL})",
    "threshold_sweep": f"SELECT * EXCLUDE (i) FROM ({_sweep_sql(LINEAR_STEPS, 'probability', AP_SQL)})",
    "percentile_sweep": f"SELECT * EXCLUDE (i) FROM ({_sweep_sql(PERCENT_STEPS, 'value', VALUE_AP_SQL, ', any_value(percentile) AS percentile')})",
    "best_threshold": f"""SELECT * EXCLUDE (i) FROM ({_sweep_sql(LINEAR_STEPS, 'probability', AP_SQL)}) ORDER BY f1 DESC, i LIMIT 1""",
    "calibration": _calibration_sql("probability", "probability"),
    "calibration_scaled": _calibration_sql("value", "(value - lo) / (hi - lo + 1e-12)"),
    "confusion": f"""
        WITH c AS (SELECT count(*) FILTER (probability >= 0.5 AND label = 1) AS tp, count(*) FILTER (probability >= 0.5 AND label = 0) AS fp,
                          count(*) FILTER (probability < 0.5 AND label = 1) AS fn, count(*) FILTER (probability < 0.5 AND label = 0) AS tn
                   FROM ({SCORES_SQL}))
        SELECT 0.5::DOUBLE AS threshold, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
               round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "class_report": f"""
        WITH s AS (SELECT label, CAST(probability >= 0.5 AS INTEGER) AS prediction FROM ({SCORES_SQL})),
        c AS (SELECT k AS class, count(*) FILTER (label = k AND prediction = k) / count(*) FILTER (prediction = k) AS pr,
                     count(*) FILTER (label = k AND prediction = k) / count(*) FILTER (label = k) AS re, count(*) FILTER (label = k) AS n
              FROM s, range(2) t(k) GROUP BY k),
        m AS (SELECT *, 2 * pr * re / (pr + re) AS f FROM c),
        a AS (SELECT avg(CAST(label = prediction AS INTEGER)) AS acc, count(*) AS n FROM s)
        SELECT CAST(class AS VARCHAR) AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, n AS support FROM m
        UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM a
        UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(sum(n) AS BIGINT) FROM m
        UNION ALL SELECT 'weighted avg', round(sum(pr * n) / sum(n), 6), round(sum(re * n) / sum(n), 6), round(sum(f * n) / sum(n), 6),
                         CAST(sum(n) AS BIGINT) FROM m""",
    "score_percentile": """
        WITH q AS (SELECT quantile_cont(value, [0.5, 0.975, 0.999]) AS q FROM events WHERE event_type <> 'error')
        SELECT count(*) FILTER (value >= q[1]) AS above_0, count(*) FILTER (value >= q[2]) AS above_1, count(*) FILTER (value >= q[3]) AS above_2,
               round(any_value(q[1]), 6) AS limit_0, round(any_value(q[2]), 6) AS limit_1, round(any_value(q[3]), 6) AS limit_2
        FROM events, q""",
    "scale_min_max": """
        WITH m AS (SELECT min(l_extendedprice) AS e0, max(l_extendedprice) AS e1, min(l_quantity) AS q0, max(l_quantity) AS q1 FROM lineitem)
        SELECT l_orderkey, l_linenumber, round((l_extendedprice - e0) / (e1 - e0 + 1e-12), 6) AS l_extendedprice,
               round((l_quantity - q0) / (q1 - q0 + 1e-12), 6) AS l_quantity FROM lineitem, m""",
    "scale_standard": "WITH m AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_COLUMNS)
    + " FROM lineitem WHERE l_returnflag = 'N') SELECT l_orderkey, l_linenumber, l_returnflag, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in LINE_COLUMNS)
    + " FROM lineitem, m",
    "perturb_numeric": f"""
        SELECT o_orderkey, round(o_totalprice + 0.5 * s * sqrt(-2 * ln(1 - ({_hash_sql('o_orderkey', _noise_seed(0))} >> 7) / 9007199254740992.0::DOUBLE))
               * cos(2 * pi() * (({_hash_sql('o_orderkey', _noise_seed(1))} >> 7) / 9007199254740992.0::DOUBLE)), 3) AS o_totalprice
        FROM orders, (SELECT stddev_pop(o_totalprice) AS s FROM orders)""",
    "stratified_split": f"""
        WITH h AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_hash_sql('o_orderkey')}) AS r FROM orders),
        c AS (SELECT o_orderstatus, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
        t AS (SELECT *, total - CAST(ceil(total * 0.2) AS BIGINT) AS train, n * (total - CAST(ceil(total * 0.2) AS BIGINT)) / total AS share FROM c),
        k AS (SELECT *, floor(share) + CAST(row_number() OVER (ORDER BY share - floor(share) DESC, o_orderstatus)
                     <= train - sum(floor(share)) OVER () AS INTEGER) AS given FROM t)
        SELECT o_orderkey, o_orderstatus, CASE WHEN r <= n - given THEN 'valid' ELSE 'train' END AS split FROM h JOIN k USING (o_orderstatus)""",
    "split_counts": """
        WITH c AS (SELECT o_orderstatus, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
        t AS (SELECT *, total - CAST(ceil(total * 0.2) AS BIGINT) AS train, n * (total - CAST(ceil(total * 0.2) AS BIGINT)) / total AS share FROM c),
        k AS (SELECT *, CAST(floor(share) AS BIGINT) + CAST(row_number() OVER (ORDER BY share - floor(share) DESC, o_orderstatus)
                     <= train - sum(floor(share)) OVER () AS BIGINT) AS given FROM t)
        SELECT o_orderstatus, 'train' AS split, given AS n FROM k UNION ALL SELECT o_orderstatus, 'valid', n - given FROM k""",
    "sample_n": f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {_hash_sql('o_orderkey')}, o_orderkey LIMIT 500",
    "sample_n_large": f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {_hash_sql('o_orderkey')}, o_orderkey LIMIT 12000",
    "sample_fraction": f"""
        WITH h AS (SELECT o_orderkey, o_orderpriority, {_hash_sql('o_orderkey')} AS h FROM orders)
        SELECT o_orderkey, o_orderpriority, 'hash' AS kind FROM h WHERE h < {int(0.3 * (1 << 60))}
        UNION ALL (SELECT o_orderkey, o_orderpriority, 'exact' FROM h ORDER BY h LIMIT (SELECT CAST(round(0.3 * count(*)) AS BIGINT) FROM orders))""",
    "complement_split": f"""
        SELECT o_orderkey, o_totalprice, CASE WHEN {_hash_sql('o_orderkey')} < {1 << 59} THEN 'reference' ELSE 'current' END AS side FROM orders""",
}
