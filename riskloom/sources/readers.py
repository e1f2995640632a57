"""Readers."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import stage
from .schemas import ANOMALY_SCORES, FEATURE_STORE, PREDICTIONS
from .sinks import _mounted, published

# A share of a scan holds 32 small files; so many shares are read by one task of a scan of very many files.
SHARES = 16
# Of a mounted folder a task reads so many files, or so many bytes.
TASK_FILES, TASK_BYTES = 2048, 32 << 20
# Entries of a folder, and bytes of files, that a task holds before it hands them on.
HELD_ENTRIES, HELD_BYTES = 8192, 4 << 20


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _require(spark: SparkSession, path: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing found at {path}")


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header line; without a schema the types are inferred in an extra pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_feature_store(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """The feature store; naming a data set reads only its partition, with the schema of its own files.

    Of a published store the current version is read. A missing path is an error. Features that are typed differ by data set, so name one to read them.
    """
    _require(spark, path)
    path = published(spark, path) or path
    own = f"{path.rstrip('/')}/dataset={dataset}"
    named = dataset is not None and path_exists(spark, own)
    store = spark.read.option("basePath", path).parquet(own) if named else spark.read.parquet(path)
    columns = [c for c in FEATURE_STORE.names if c in store.columns] + [c for c in store.columns if c not in FEATURE_STORE.names]
    store = store.select(*columns)
    return select_dataset(store, dataset) if dataset else store


def select_dataset(store: DataFrame, dataset: str) -> DataFrame:
    """Rows of one data set; having none is an error."""
    rows = store.where(F.col("dataset") == F.lit(dataset))
    if rows.isEmpty():
        raise ValueError(f"no rows for dataset {dataset!r}")
    return rows


def read_predictions(spark: SparkSession, path: str, anomaly: bool = False) -> DataFrame:
    """CSV of scores with a label."""
    _require(spark, path)
    return read_csv_table(spark, path, ANOMALY_SCORES if anomaly else PREDICTIONS)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The numbers at the top level of a JSON metrics file as ``(metric, value)``; none if it is missing."""
    empty = spark.createDataFrame([], "metric string, value double")
    if not path_exists(spark, path):
        return empty
    document = spark.read.option("multiLine", True).json(path)
    names = [f.name for f in document.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not names:
        return empty
    entries = [F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]
    return document.select(F.explode(F.array(*entries)).alias("m")).select("m.*").where("value is not null")


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers pass over."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folders, and files that are not empty, directly below the given folders; a path that is a file stands for itself."""
    names = ["path", "name", "folder", "size"]
    packed = lambda found: pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found)))), pa.schema(
        [("path", pa.string()), ("name", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())]
    ))
    found = []
    for batch in batches:
        for path in batch["path"].to_pylist():
            if os.path.isfile(path):
                found += [(path, os.path.basename(path), False, size)] if (size := os.path.getsize(path)) else []
                continue
            with os.scandir(path) as entries:
                for entry in entries:
                    folder = entry.is_dir()
                    if _hidden(entry.name, folder) or not (folder or entry.is_file()):
                        continue
                    size = 0 if folder else entry.stat().st_size
                    if folder or size:
                        found.append((entry.path, entry.name, folder, size))
                    if len(found) >= HELD_ENTRIES:
                        yield packed(found)
                        found = []
    if found:
        yield packed(found)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of the given paths, a few MB at a time."""
    packed = lambda paths, held: pa.RecordBatch.from_arrays(
        [pa.array([f"file:{p}" for p in paths], pa.string()), pa.array(held, pa.binary())], names=["path", "content"]
    )
    paths, held, size = [], [], 0
    for batch in batches:
        for path in batch["path"].to_pylist():
            with open(path, "rb") as file:
                held.append(file.read())
            paths.append(path)
            size += len(held[-1])
            if size >= HELD_BYTES or len(held) >= HELD_ENTRIES:
                yield packed(paths, held)
                paths, held, size = [], [], 0
    if held:
        yield packed(paths, held)


def _mounted_files(spark: SparkSession, roots: Sequence[str], pattern: str) -> DataFrame:
    """``(path, content)`` of the files below mounted folders.

    Tasks list the folders level by level and read the files; the driver sees whether a level has folders, and how many
    files and bytes there are, but no names.
    """
    lanes = spark.sparkContext.defaultParallelism
    wanted = f"\\A(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()})\\z"
    level, levels = spark.createDataFrame([(r,) for r in roots], "path string").distinct(), []
    while not levels or not level.isEmpty():
        found = level.repartition(lanes, "path").mapInArrow(_entries, "path string, name string, folder boolean, size long")
        levels.append(stage(found.where(F.col("folder") | F.col("name").rlike(wanted)), "entries"))
        level = levels[-1].where("folder").select("path").distinct()
    files = levels[0]
    for other in levels[1:]:
        files = files.unionAll(other)
    # Folders that lie below one another list a file more than once.
    files = files.where("NOT folder").select("path", "size")
    files = files.distinct() if len(roots) > 1 else files
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(lanes, -(-n // TASK_FILES), -(-size // TASK_BYTES))
    return files.select("path").repartition(tasks, "path").mapInArrow(_contents, "path string, content binary")


def _stored_files(spark: SparkSession, paths: Sequence[str], pattern: str) -> DataFrame:
    """``(path, content)`` of the files below folders of other stores, whose names the driver lists."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = reader.load(list(paths)).select("path", "content")
    shares = files._jdf.queryExecution().toRdd().getNumPartitions()
    return files.coalesce(max(spark.sparkContext.defaultParallelism, -(-shares // SHARES)))


def read_documents(spark: SparkSession, *paths: str, pattern: str = "*.md") -> DataFrame:
    """One row ``(source, text)`` per file below the given folders; files that are not UTF-8 are left out, and empty ones.

    Folders that do not exist are skipped. The files of mounted folders are listed when this is called and read by the tasks.
    """
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        return spark.createDataFrame([], "source string, text string")
    roots = [_mounted(spark, p) for p in present]
    near, far = [r for r in roots if r is not None], [p for p, r in zip(present, roots) if r is None]
    parts = ([_mounted_files(spark, near, pattern)] if near else []) + ([_stored_files(spark, far, pattern)] if far else [])
    files = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    raw = F.col("content").cast("string")
    # Judged before line ends are changed: regexp_replace turns bad bytes into valid replacement characters.
    decoded = files.where(F.is_valid_utf8(raw))
    return decoded.select(F.col("path").alias("source"), F.regexp_replace(raw, "\\r\\n?", "\n").alias("text"))
