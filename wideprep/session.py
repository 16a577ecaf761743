"""Session helpers: builder for local runs and the shared storage folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "wideprep") -> SparkSession:
    """Session for tests and the local bench (UI off, AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.maxFields", "1000")
        .getOrCreate()
    )


# the longest method, in bytes of code, that the JVM compiles
COMPILED_METHOD = 8000


def wide_rows(spark: SparkSession) -> None:
    """Prepare the session for wide tables: Spark's generated code of one step over a hundred columns is one method too long
    for the JVM to compile, and an interpreted one takes several times as long. Such steps are run in short methods.
    A lower limit set by the user stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > COMPILED_METHOD:
        spark.conf.set(limit, str(COMPILED_METHOD))


# how stored tables that only this package reads back are written
STORED = {"compression": "zstd"}


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when their action ends, not whenever the driver collects garbage: for steps that store a
    table which is read from then on. The session's own setting comes back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def storage_dir(spark: SparkSession) -> str:
    """Shared folder for materialised intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or the context's checkpoint
    directory). Only a local-mode session without either falls back to a
    fresh temporary folder; on a cluster that is an error, because a
    machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)")
        configured = tempfile.mkdtemp(prefix="wideprep-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    base = storage_dir(spark)
    return os.path.join(base, "wideprep", f"{name}-{sc_app_id(spark)}-{uuid.uuid4().hex[:12]}")


def sc_app_id(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId.replace("/", "_")


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared storage folder, and read back; the shuffle files that made it go."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with freed_shuffles(spark):
        df.write.options(**STORED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
