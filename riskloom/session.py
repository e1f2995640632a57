"""Session set-up and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app_name: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and a fixed UTC zone; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    In local mode one is made when the setting is absent, since driver and executors are one
    process there. On a cluster the setting is required: a machine-local folder would lose data.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        # The setting is fixed once a session runs, so the folder is remembered here.
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="riskloom-")
        path = _LOCAL_DIRS[app]
    return path.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Give the context a checkpoint folder (iterative fits cut their lineage with it)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/riskloom/{app}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives the loss of executors.

    With ``by`` there is a folder for each value of that column, so that a filter on it reads no others.
    Used where a costly table is read several times. The shuffle files of the write go when it has ended. The table
    stays until ``drop_staged`` is called or the cluster expires its checkpoint folder.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, *tables: DataFrame) -> bool:
    """Delete the given staged tables, or all that this application has staged. Nothing may read them any more."""
    root = f"{shared_dir(spark)}/riskloom/{spark.sparkContext.applicationId}"
    paths = [f"{root}/{t.inputFiles()[0].split(root.split('/')[-1] + '/')[-1].split('/')[0]}" for t in tables] if tables else [root]
    jvm = spark._jvm
    targets = [jvm.org.apache.hadoop.fs.Path(path) for path in paths]
    return all([t.getFileSystem(spark._jsc.hadoopConfiguration()).delete(t, True) for t in targets])
