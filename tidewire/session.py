"""Session defaults, and tables that jobs write on the way."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # small shuffles feed costly text work here, keep them on all cores
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def local_dir() -> str:
    return tempfile.mkdtemp(prefix="tidewire-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local runs without one get a temporary folder.

    A cluster must name a shared folder itself, a local path would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = local_dir()
    return configured


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables a job writes on the way."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def temporary_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder that goes when the application ends, or the enclosing :func:`tables_freed`."""
    path = run_dir(spark, name)
    if scopes.open:
        scopes.open[-1].append(path)
    else:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


class Scopes(threading.local):
    """The paths to free, by open scopes of this thread."""

    def __init__(self):
        self.open: list[list[str]] = []


scopes = Scopes()


@contextmanager
def tables_freed(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`durable` writes inside go when the block ends: for jobs that run on, such as streams."""
    scopes.open.append([])
    try:
        yield
    finally:
        for path in scopes.open.pop():
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder once and go on from there.

    Later reads take the columns they need and survive lost executors. The folder is removed when
    the application ends, or the enclosing :func:`tables_freed`.
    """
    spark = df.sparkSession
    path = temporary_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
