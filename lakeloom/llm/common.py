"""Helpers that several corpus operators share: words, lineage cuts, distributed ranks and running totals."""

from __future__ import annotations

import contextlib
import contextvars
import os
import pathlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java pattern of one run of ASCII white space (space, and tab to carriage return).
SPACES = "[\\x09-\\x0D\\x20]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run, once per application (as ``--py-files`` does)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: ``spark.checkpoint.dir``. Where that is unset, a temporary folder in local mode
    (tests), and an error on a cluster, whose executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"lakeloom-{spark.sparkContext.applicationId}")
    return root.rstrip("/")


_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def materialize(df: DataFrame, label: str, compression: str = "snappy", scoped: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan that follows starts from files that every executor sees, so a lost executor costs only its own tasks and
    no expensive stage runs twice. Spark's file commit makes retried tasks safe. The files go when the session ends, or with the
    ``dropped_after`` around, unless they aren't ``scoped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    files, jvm_path = _files(spark, path)
    files.deleteOnExit(jvm_path)
    if scoped and _SCOPE.get() is not None:
        _SCOPE.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


@contextlib.contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside go at the end: for steps whose result has been written by then."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        paths = _SCOPE.get() or []
        _SCOPE.reset(token)
        for path in paths:
            files, jvm_path = _files(spark, path)
            files.delete(jvm_path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """Each of ``names``, lengthened until no column is called so: for helper columns beside columns of any name."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, also where ``body`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words as a long, without keeping them."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, SPACES)
    edges = t.rlike("^[\\x09-\\x0D\\x20]").cast("int") + t.rlike("[\\x09-\\x0D\\x20]\\z").cast("int")
    return F.when(t.rlike("[^\\x09-\\x0D\\x20]"), F.size(parts) - edges).otherwise(0).cast("long")


def distributed_rank(df: DataFrame, group: list[str], order: list[str], label: str, rank: str = "rank") -> DataFrame:
    """Rows of ``df`` with their 0-based rank within ``group`` by ``order``, without ever sorting a group in one task.

    A range shuffle puts consecutive rows into one partition, rows are numbered within (partition, group), and the
    counts of earlier partitions are added. A group of any size is spread over as many partitions as its rows need; the
    table of counts has at most partitions + groups rows. ``order`` should end in a unique column; rows that tie
    completely get consecutive ranks in any order. Columns of ``group`` may not be null.
    """
    pid, local, count, before = "_part", "_local", "_count", "_before"
    ranged = df.repartitionByRange(*[F.col(c) for c in group + order]).withColumn(pid, F.spark_partition_id())
    numbered = ranged.withColumn(local, F.row_number().over(Window.partitionBy(pid, *group).orderBy(*order)).cast("long"))
    kept = materialize(numbered, label)
    counts = kept.groupBy(pid, *group).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(count).over(earlier), F.lit(0).cast("long"))).drop(count)
    return kept.join(counts, [pid, *group]).withColumn(rank, F.col(local) - 1 + F.col(before)).drop(pid, local, before)


def running_total(df: DataFrame, order: list[str], value: str, label: str, total: str = "start") -> DataFrame:
    """Rows of ``df`` with the sum of ``value`` over all rows before them by ``order``, in distributed form.

    As in ``distributed_rank``: sums within range partitions plus the totals of earlier partitions (a table of one row
    per partition). Rows that tie completely follow each other in any order.
    """
    pid, local, part, before = "_part", "_local", "_total", "_before"
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn(pid, F.spark_partition_id())
    within = Window.partitionBy(pid).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kept = materialize(ranged.withColumn(local, F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long")), label)
    totals = kept.groupBy(pid).agg(F.sum(value).alias(part))
    earlier = Window.partitionBy(F.lit(0)).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(before, F.coalesce(F.sum(part).over(earlier), F.lit(0)).cast("long")).drop(part)
    return kept.join(totals, pid).withColumn(total, F.col(local) + F.col(before)).drop(pid, local, before)
