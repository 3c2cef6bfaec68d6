"""Shared folder for tables that a query writes and reads again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, dropped when the session ends.

    Where that is unset: a temporary folder in local mode, an error on a cluster, whose executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"lakeloom-{spark.sparkContext.applicationId}")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete what was written to ``path``; nothing may read it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Setting of Spark under which an execution's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files of one execution don't stay on the disks while the next one runs. For steps that start from tables, not from earlier shuffles."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to a new path and read back: what follows starts from files that every executor sees. ``codec`` is the session's if it is None."""
    path = scratch(df.sparkSession, name)
    (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
