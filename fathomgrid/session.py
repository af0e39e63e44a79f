"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share (see `checkpointed`)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        _use_shared(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _use_shared(spark: SparkSession) -> None:
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage.

    The folder is the cluster's `spark.checkpoint.dir`; a folder of our own is set only where
    the session names none (single-machine runs and tests).
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        _use_shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: what several passes read is made once."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_session(cpus: int | str = "*", **conf) -> SparkSession:
    """Local session used by tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fathomgrid")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
