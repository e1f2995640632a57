import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features as ft
from riskloom.operators import validate as va
from riskloom.plans.feature_store import balance_report, build_feature_store
from riskloom.sources import readers, sinks
from riskloom.sources.schemas import CHURN_FEATURES, CHURN_RAW, FRAUD_FEATURES, FRAUD_RAW

from helpers import plan_of

CHURN_ROWS = [
    (1, 100, "A", 750, "France", "Female", 40, 2, 10.0, 1, 1, 1, 5.0, 1),
    (2, 101, "B", None, "Spain", "Male", 41, None, 0.0, 2, 0, 0, 0.0, 0),
    (3, 102, "C", 550, "Spain", "Male", 42, 6, 3.0, 2, 0, 1, None, 0),
]


def fraud_rows(n=40):
    return [(float(i * 1800), *[float(i % 7) * v for v in range(1, 29)], float(i), int(i % 10 == 0)) for i in range(n)]


@pytest.fixture(scope="module")
def raw_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    # Two equal transactions: a copy is a row of its own.
    rows = fraud_rows() + fraud_rows(1)
    sinks.write_csv_table(spark.createDataFrame(CHURN_ROWS, CHURN_RAW), f"{root}/bank_churn/Churn_Modelling.csv")
    sinks.write_csv_table(spark.createDataFrame(rows, FRAUD_RAW), f"{root}/creditcard_fraud/creditcard.csv")
    return root


@pytest.fixture(scope="module")
def built(spark, raw_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("store"))
    return build_feature_store(spark, raw_dir, f"{out}/processed", f"{out}/store", f"{out}/balance")


def test_clean_churn(spark):
    rows = {r["customer_id"]: r for r in ft.clean_churn(spark.createDataFrame(CHURN_ROWS, CHURN_RAW)).collect()}
    assert "Surname" not in rows[100].asDict() and rows[100]["label"] == 1
    assert (rows[100]["credit_score_bucket"], rows[100]["tenure_bucket"], rows[100]["balance_salary_ratio"]) == ("excellent", "short", 2.0)
    assert (rows[101]["credit_score_bucket"], rows[101]["tenure_bucket"], rows[101]["balance_salary_ratio"]) == ("poor", "long", 0.0)
    assert (rows[102]["credit_score_bucket"], rows[102]["tenure_bucket"], rows[102]["balance_salary_ratio"]) == ("fair", "medium", 0.0)


def test_build(spark, built):
    store = readers.read_feature_store(spark, built.store)
    assert store.columns == ["entity_id", "dataset", "features", "label"]
    assert {r["dataset"]: r["count"] for r in store.groupBy("dataset").count().collect()} == {"churn": 3, "fraud": 41}
    assert va.overall(va.validate_feature_store(store)).first()["success"]
    fields = list(json.loads(store.where("entity_id = '100'").first()["features"]))
    assert fields == CHURN_FEATURES.names
    # Missing fields are absent from the text and come back as null.
    sparse = store.where("entity_id = '101'")
    assert "CreditScore" not in json.loads(sparse.first()["features"])
    assert ft.unpack_features(sparse, CHURN_FEATURES).first()["CreditScore"] is None


def test_partition_pruning(spark, built):
    plan = plan_of(readers.read_feature_store(spark, built.store, "fraud").select("entity_id"))
    assert "PartitionFilters: [isnotnull(dataset" in plan and "ReadSchema: struct<entity_id:string>" in plan


def test_typed_store_prunes_fields(spark, raw_dir, tmp_path):
    paths = build_feature_store(spark, raw_dir, f"{tmp_path}/p", f"{tmp_path}/s", typed=True)
    fraud = spark.read.parquet(f"{paths.store}/dataset=fraud")
    wide = ft.unpack_features(fraud, FRAUD_FEATURES)
    assert wide.count() == 41 and wide.where("time_hours = 1").count() == 2
    assert "features:struct<Amount:double>" in plan_of(wide.select("Amount"))
    for dataset, column in (("fraud", "Amount"), ("churn", "Geography")):
        store = readers.read_feature_store(spark, paths.store, dataset)
        assert column in store.schema["features"].dataType.names and store.select("dataset").distinct().first()[0] == dataset



def test_missing_store_and_dataset(spark, built):
    with pytest.raises(FileNotFoundError):
        readers.read_feature_store(spark, "/tmp/there-is-no-such-store")
    with pytest.raises(ValueError):
        readers.read_feature_store(spark, built.store, "other")


def test_balance_report(spark, built):
    churn, fraud = spark.read.parquet(built.churn), spark.read.parquet(built.fraud)
    report = {r["dataset"]: r["balance"] for r in balance_report(churn, fraud).collect()}
    assert report["churn"] == {"0": pytest.approx(2 / 3), "1": pytest.approx(1 / 3)}
    assert sum(report["fraud"].values()) == pytest.approx(1)


def test_row_id_is_stable_and_counts_copies(spark, monkeypatch):
    rows = [(i % 5, "x") for i in range(23)]
    df = spark.createDataFrame(rows, "a int, b string")
    ids = sorted(r["transaction_id"] for r in ft.row_id(df).collect())
    assert len(set(ids)) == 23
    assert sorted(r["transaction_id"] for r in ft.row_id(df.repartition(7)).collect()) == ids
    # Rows with many copies unfold in blocks, with the same numbers.
    monkeypatch.setattr(ft, "COPIES_PER_ROW", 2)
    assert sorted(r["transaction_id"] for r in ft.row_id(df).collect()) == ids
    assert ft.row_id(df, method="position").select("transaction_id").distinct().count() == 23


def test_nested_unpack(spark):
    df = spark.createDataFrame([("1", '{"a": {"b": 1, "c": "x"}, "d": 2.5}')], "entity_id string, features string")
    schema = spark.createDataFrame([], "a struct<b: int, c: string>, d double").schema
    assert ft.unpack_features(df, schema, keep=("entity_id",)).first().asDict() == {"entity_id": "1", "a_b": 1, "a_c": "x", "d": 2.5}


def report_of(spark, rows):
    df = spark.createDataFrame(rows, "entity_id string, dataset string, features string, label int")
    return {r["name"]: r for r in va.validate_feature_store(df).collect()}


def test_validation_finds_every_fault(spark):
    report = report_of(spark, [("1", "fraud", "{}", 0), ("1", "fraud", "{}", 1), (None, "loan", None, None), ("2", None, "{}", 7)])
    assert report["row_count_positive"]["details"] == "row_count=4"
    assert report["entity_id_not_null"]["details"] == "null_count=1"
    assert report["dataset_values_valid"]["details"] == "unexpected=[None, 'loan']"
    assert report["label_values_valid"]["details"] == "unexpected_labels=[None, 7]"
    assert report["features_not_null"]["details"] == "null_count=1"
    assert report["entity_dataset_unique"]["details"] == "duplicate_count=1"
    assert [n for n, r in report.items() if r["success"]] == ["row_count_positive"]


def test_validation_of_an_empty_store(spark):
    report = report_of(spark, [])
    assert not report["row_count_positive"]["success"] and report["entity_dataset_unique"]["success"]


def test_long_listings_stay_short(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("entity_id"), F.concat(F.lit("d"), "id").alias("dataset"), F.lit("{}").alias("features"), F.lit(0).alias("label"))
    details = {r["name"]: r["details"] for r in va.validate_feature_store(df).collect()}["dataset_values_valid"]
    assert details.endswith("80 more]") and va.unexpected_values(df, "dataset", va.DATASETS).count() == 100
    strays = va.stray_values(df).where("check = 'dataset_values_valid'")
    assert strays.columns == ["check", "value", "n"] and strays.count() == 100


def test_require_valid(spark):
    df = spark.createDataFrame([("a", True, None), ("b", False, "x")], "name string, success boolean, details string")
    with pytest.raises(va.ValidationError, match="b"):
        va.require_valid(df)
    assert len(va.require_valid(df.where("success"))) == 1


def test_validate_raw(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (1, -1.0, "b"), (2, None, None)], "id int, amount double, kind string")
    rules = [
        va.Rule("positive", "non_negative", "amount"),
        va.Rule("present", "not_null", "amount"),
        va.Rule("domain", "in_set", "kind", values=("a",)),
        va.Rule("range", "in_range", "amount", low=0.0, high=4.0),
        va.Rule("key", "unique", "id"),
    ]
    assert {r["name"]: r["violations"] for r in va.validate_raw(df, rules).collect()} == {
        "positive": 1, "present": 1, "domain": 2, "range": 2, "key": 1,
    }


def test_metrics_documents_and_log(spark, tmp_path):
    path = tmp_path / "metrics.json"
    path.write_text(json.dumps({"auc": 0.9, "n": 3, "name": "x", "curve": [1, 2], "gone": None}, indent=2))
    assert {r["metric"]: r["value"] for r in readers.read_metrics(spark, str(path)).collect()} == {"auc": 0.9, "n": 3.0}
    assert readers.read_metrics(spark, str(tmp_path / "none.json")).count() == 0
    docs = tmp_path / "docs" / "deep"
    docs.mkdir(parents=True)
    (docs / "a.md").write_text("héllo\n\nworld")
    (docs / "b.md").write_bytes(b"\xff\xfe\xfa")
    (docs / "c.txt").write_text("other")
    found = readers.read_documents(spark, str(tmp_path / "docs"), str(tmp_path / "absent")).collect()
    assert [r["text"] for r in found] == ["héllo\n\nworld"] and found[0]["source"].endswith("a.md")
    assert readers.read_documents(spark, str(tmp_path / "absent")).count() == 0
    log = str(tmp_path / "runs")
    assert sinks.log_run(spark, None, "r", "n") is None
    sinks.log_run(spark, log, "r1", "n", metrics={"auc": 0.5}, params={"k": 1}, artifacts={"model": "/m"})
    sinks.log_run(spark, log, "r2", "n", metrics={"auc": 0.6})
    sinks.log_run(spark, log, "r1", "n", metrics={"auc": 0.7})
    runs = {(r["run_id"], r["kind"], r["key"]): r["value"] for r in sinks.read_runs(spark, log).collect()}
    assert runs == {("r1", "metric", "auc"): "0.7", ("r2", "metric", "auc"): "0.6"}


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    assert sinks.published(spark, path) is None
    first = sinks.publish(spark.range(3).withColumn("dataset", F.lit("a")), path, ["dataset"])
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"), F.lit("a").alias("dataset"))
    with pytest.raises(Exception, match="killed"):
        sinks.publish(broken, path, ["dataset"])
    # The old version is still the current one.
    assert sinks.published(spark, path) == first and spark.read.parquet(first).count() == 3
    second = sinks.publish(spark.range(5).withColumn("dataset", F.lit("b")), path, ["dataset"])
    third = sinks.publish(spark.range(6).withColumn("dataset", F.lit("b")), path, ["dataset"])
    assert sinks.published(spark, path) == third and spark.read.parquet(third).count() == 6
    # The version before and the current one are kept, what the killed writer left is gone.
    assert sorted(p.name for p in (tmp_path / "table").glob("v-*")) == sorted(p.rsplit("/", 1)[-1] for p in (second, third))
    assert readers.read_feature_store(spark, path, "b").count() == 6


def test_csv_inference(spark, tmp_path):
    sinks.write_csv_table(spark.createDataFrame([(1, "a", 2.5)], "i int, s string, d double"), str(tmp_path / "t"))
    assert readers.read_csv_table(spark, str(tmp_path / "t")).dtypes == [("i", "int"), ("s", "string"), ("d", "double")]


def test_many_documents(spark, tmp_path, monkeypatch):
    texts = spark.range(1500).select(F.when(F.col("id") != 7, F.concat(F.lit("note é\n"), (F.col("id") % 1400).cast("string"))).alias("text")).repartition(3)
    sinks.write_documents(texts, str(tmp_path / "own"))
    found = readers.read_documents(spark, str(tmp_path / "own"), pattern="*.txt")
    # One row per file, read by few tasks; files are written without checksums and are not listed from one folder.
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.count() == 1500 and not list((tmp_path / "own").rglob("*.crc"))
    written = texts.select(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    assert found.select("text").exceptAll(written).isEmpty() and written.exceptAll(found.select("text")).isEmpty()
    # A store that is not mounted takes the same files from Spark's writer.
    monkeypatch.setattr(sinks, "_mounted", lambda spark, path: None)
    sinks.write_documents(texts.limit(20), str(tmp_path / "other"))
    assert readers.read_documents(spark, str(tmp_path / "other"), pattern="*.txt").count() == 20


def test_documents_are_listed_by_tasks(spark, tmp_path):
    for name, text in {
        "a/1.txt": "one\r\ntwo", "a/b/c/2.txt": "é", "3.txt": "three", "a/empty.txt": "", "a/.hidden.txt": "h", "_x/4.txt": "h", ".y/5.txt": "h",
        "k=1/6.txt": "six", "a b%20/7.txt": "seven", "8.md": "other", "9.txt.bak": "other",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,text}")
    listed = sorted((r["path"], r["content"].decode().replace("\r\n", "\n")) for r in reader.load(str(tmp_path)).collect())
    found = readers.read_documents(spark, str(tmp_path), str(tmp_path / "a"), str(tmp_path / "a" / "1.txt"), pattern="*.{txt,text}")
    assert sorted(map(tuple, found.collect())) == listed and len(listed) == 5
    # No list of the files is in the driver's plan.
    assert not [f for f in found.inputFiles() if str(tmp_path) in f] and "binaryFile" not in plan_of(found)
    assert readers.read_documents(spark, str(tmp_path), pattern="*.none").count() == 0
