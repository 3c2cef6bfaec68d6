"""Ranks, positions and n-tiles over all rows of a table, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.scratch import written


def counts_before(parts: DataFrame, part: str, count: str, before: str) -> DataFrame:
    """``parts`` (one row per partition) with the sum of ``count`` over earlier parts."""
    earlier = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(before, F.coalesce(F.sum(count).over(earlier), F.lit(0)).cast("long"))


def positioned(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place from 0 in ``order`` (which should be unique): range partitions, numbers within each, and the rows of earlier ones."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    held = written(ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "positions")
    parts = counts_before(held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part", "_n", "_before").select("_part", "_before")
    return held.join(F.broadcast(parts), "_part").withColumn(name, F.col("_local") - 1 + F.col("_before")).drop("_part", "_local", "_before")  # one row per partition


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """SQL's rank by ``value``, largest first and null last: 1 and the number of rows before; equal values share it.

    ``df`` is written once, since it is counted and met again. Rows are counted by value first, so that a value of any frequency is one row for each task, and it is the different values that are sorted.
    """
    df = written(df, "ranked")
    absent = F.col(value).isNull()
    values = df.groupBy(absent.alias("_none"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    order = [F.asc("_none"), F.desc("_value")]
    ranged = values.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = written(ranged.withColumn("_ahead", F.coalesce(F.sum("_rows").over(within), F.lit(0))), "ranks")
    parts = counts_before(held.groupBy("_part").agg(F.sum("_rows").alias("_n")), "_part", "_n", "_before").select("_part", "_before")
    ranks = held.join(F.broadcast(parts), "_part").select("_value", (F.col("_ahead") + F.col("_before") + 1).cast("int").alias(name))  # one row per partition
    return df.join(ranks, df[value].eqNullSafe(ranks["_value"])).drop("_value")


def tiles(df: DataFrame, order: list, n: int, name: str) -> DataFrame:
    """SQL's ntile in ``order`` (which should be unique): the first parts have one row more where the rows don't divide."""
    placed = positioned(df, order, "_place")
    total = placed.agg(F.count(F.lit(1)).alias("_total"))
    met = placed.crossJoin(F.broadcast(total))  # one row
    size, larger = F.floor(F.col("_total") / n), F.col("_total") % n
    head = larger * (size + 1)
    tile = F.when(F.col("_place") < head, F.floor(F.col("_place") / (size + 1))).otherwise(larger + F.floor((F.col("_place") - head) / size))
    return met.withColumn(name, (tile + 1).cast("int")).drop("_place", "_total")
