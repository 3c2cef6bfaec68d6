"""Duplicates: exact ones, and older versions of a key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.scratch import written

#: Fingerprints that are broadcast; where more are repeated, all rows are compared whole, in one shuffle.
AT_ONCE = 1_000_000


def _fingerprint(columns: Sequence[str]) -> dict[str, Column]:
    """Hash of the columns; equal rows have equal ones. Rows that share one by chance are only compared in vain."""
    return {"_fp1": F.xxhash64(*columns)}


def _where_repeated(df: DataFrame, columns: Sequence[str], pick: Callable[[DataFrame], DataFrame], near: Sequence[str] = ()) -> DataFrame:
    """``pick`` of the rows whose ``columns`` stand more than once; the others stay where they are."""
    marks = _fingerprint(columns)
    marked = df.withColumns(marks)
    counts = marked.groupBy(*marks).agg(F.count(F.lit(1)).alias("_n"))
    again = written(counts.where("_n > 1").select(*marks), "fingerprints")
    if again.count() > AT_ONCE:
        return pick(df.repartition(*near) if near else df)
    alone, met = (marked.join(F.broadcast(again), list(marks), how) for how in ("left_anti", "left_semi"))
    return alone.unionByName(pick(met)).drop(*marks)


def drop_exact_duplicates(df: DataFrame, columns: Sequence[str], first_by: Sequence[str | Column], near: Sequence[str] = ()) -> DataFrame:
    """One row of those that agree in all ``columns`` (nulls are equal): the first by ``first_by``.

    Fingerprints are counted first, with map-side combine. Rows whose fingerprint stands alone stay where they are; only the others are shuffled
    and compared as whole rows, so rows that share a fingerprint by chance all stay. ``df`` is read three times and should be a table, not a costly plan.
    Where all rows are shuffled, they are dealt by the columns ``near``, some of ``columns``: a join by them that follows needs no shuffle of its own.
    """
    order = Window.partitionBy(*columns).orderBy(*first_by)
    first = lambda rows: rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return _where_repeated(df, columns, first, near)


def keep_latest(df: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """The newest row of each key.

    ``version`` lists columns from the most important one; each is compared downwards with nulls last. End it with a
    unique column. A window rank lets Spark push a group limit below the shuffle, so that each task sends one
    row for each key.
    """
    order = [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in version]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def keep_latest_of_few(df: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """``keep_latest`` of a table most of whose keys stand once: only rows whose key is repeated are shuffled whole. ``df`` is read three times."""
    return _where_repeated(df, keys, lambda rows: keep_latest(rows, keys, version))


def removed_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, those that stay when exact duplicates in ``columns`` go, and those that go."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("removed"))
