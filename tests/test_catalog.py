import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# The training-data queries are a part of their own with tests of their own.
PARTS = [p for p in entry.PARTS if p.__name__.startswith("catalog.")]
QUERIES = {name: query for p in PARTS for name, query in p.QUERIES.items()}
SQL = {name: sql for p in PARTS for name, sql in p.SQL.items()}
# The slow ones are compared by tools/check_oracle.py on the larger tables.
QUICK = [n for n in SQL if n not in ("document_files", "source_list", "summaries")]


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(float(value)) if isinstance(value, float) or type(value).__name__ == "Decimal" else str(value)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(str([plain(v) for v in r]) for r in cursor.fetchall())


def test_registry():
    assert set(SQL) <= set(QUERIES)
    without = set(QUERIES) - set(SQL)
    assert without == {
        "fraud_model", "feature_importance", "training_history", "churn_model", "anomaly_model", "neural_anomaly_model", "neural_anomaly_history",
        "tree_attribution", "training_pipeline",
    }


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


def test_no_forbidden_calls_in_the_library():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "riskloom")
    for folder, _, files in os.walk(root):
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file), encoding="utf-8") as f:
                    text = f.read()
                assert not re.search(r"localCheckpoint|crossJoin|toPandas|\.rdd\b|F\.udf\b", text), file
