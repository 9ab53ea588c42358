"""Session and intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks. On a cluster the job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("contactline")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of a batch of rows in a Python worker.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Makes Spark hand rows to Python in batches of BATCH bytes (or one row), so that a task's
    memory does not depend on how many rows a task has, nor on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="contactline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``. Where it is unset, a session whose
    tasks run in this process has one of its own, removed at the end; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return _own_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/contactline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches read, and read it back: columnar, and safe when
    executors are lost."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
