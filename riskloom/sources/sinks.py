"""Sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

POINTER = "_CURRENT"
# Documents of one folder, so that folders are listed side by side.
FOLDER_FILES = 1024


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a Parquet table; the feature store is partitioned by ``dataset``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new version of a table beside the old one, then point to it; ``published`` names the current one.

    The pointer is replaced by one rename, after all files are there: a writer that is killed leaves the old version
    readable, and a writer that runs again makes a version of its own. The version before the last one is kept for readers
    that have begun with it; older ones and what killed writers have left go.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    before = published(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{version}")
    root = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = root.getFileSystem(conf)
    draft, pointer = (jvm.org.apache.hadoop.fs.Path(fs.makeQualified(root), name) for name in (f"_{version}", POINTER))
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, pointer, replace)
    kept = {version, before.rsplit("/", 1)[-1] if before else version}
    for status in fs.listStatus(root):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)
    return f"{path}/{version}"


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version of a published table; none if ``path`` holds no such table."""
    jvm = spark._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(path, POINTER)
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    version = bytes(stream.readAllBytes()).decode()
    stream.close()
    return f"{path}/{version}"


def write_json_report(df: DataFrame, path: str) -> None:
    """Replace a report, one JSON object per row; missing values are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv_table(df: DataFrame, path: str) -> None:
    """Replace a CSV table with header lines."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the tasks' own file system has it; none if it is in another store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_documents(texts: DataFrame, path: str) -> None:
    """One ``.txt`` file per row of a table with one text column, each ended by a line break, in folders below a new path.

    On a mounted folder the tasks write the files themselves: Hadoop's local file system starts a process for every file
    it makes, and a second one for its checksum. Other stores take them from Spark's writer.
    """
    root = _mounted(texts.sparkSession, path)
    if root is None:
        texts.write.option("maxRecordsPerFile", 1).text(path)
        return

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own = 0, TaskContext.get()
        for batch in batches:
            for text in batch[0]:
                folder = f"{root}/part-{own.partitionId():05d}/{n // FOLDER_FILES:05d}"
                if n % FOLDER_FILES == 0:
                    os.makedirs(folder, exist_ok=True)
                # A second attempt of a task replaces whole files.
                draft = f"{folder}/.{n:09d}-{own.taskAttemptId()}"
                with open(draft, "wb") as file:
                    file.write(((text.as_py() or "") + "\n").encode())
                os.replace(draft, f"{folder}/{n:09d}.txt")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    os.makedirs(root, exist_ok=True)
    texts.mapInArrow(of, "n long").agg(F.sum("n")).collect()


def log_run(
    spark: SparkSession,
    path: str | None,
    run_id: str,
    run_name: str,
    metrics: Mapping[str, float] | None = None,
    params: Mapping[str, object] | None = None,
    artifacts: Mapping[str, str] | None = None,
) -> DataFrame | None:
    """Add a run to a long table ``(run_id, run_name, ts, kind, key, value)``; nothing without a path.

    Each run has a folder of its own, which a run of the same id replaces: a job that is run again is logged once.
    """
    if not path:
        return None
    rows = [
        (run_id, run_name, kind, str(key), str(value))
        for kind, entries in (("metric", metrics), ("param", params), ("artifact", artifacts))
        for key, value in (entries or {}).items()
    ]
    table = (
        spark.createDataFrame(rows, "run_id string, run_name string, kind string, key string, value string")
        .withColumn("ts", F.current_timestamp())
        .select("run_id", "run_name", "ts", "kind", "key", "value")
    )
    replace = table.withColumn("run", F.concat(F.lit("run-"), "run_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    replace.partitionBy("run").parquet(path)
    return table


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All logged runs."""
    return spark.read.parquet(path).select("run_id", "run_name", "ts", "kind", "key", "value")
