"""Exact distinct counts that add up: sets of ids as bitmaps, made once at the finest level and merged to coarser ones.

A bitmap covers 32,768 consecutive ids in 4 KB, so ids should be dense (``dense_ids`` numbers others). Merging is a bitwise
or with map-side combine: a month is counted from its days, a range of days from theirs, and no row is read or expanded again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.ordered import positioned


def dense_ids(df: DataFrame, id: str, name: str) -> DataFrame:
    """The different values of ``id`` (not null) with a number from 0 in their order."""
    return positioned(df.select(id).where(F.col(id).isNotNull()).distinct(), [F.col(id)], name)


def id_sets(df: DataFrame, group: Sequence[str], id: str) -> DataFrame:
    """For each group and stretch of ids (``id_bucket``) the set ``ids`` of ids that occur; null ids are none."""
    number = F.col(id).cast("long")
    rows = df.where(number.isNotNull()).select(*group, F.bitmap_bucket_number(number).alias("id_bucket"), F.bitmap_bit_position(number).alias("_bit"))
    return rows.groupBy(*group, "id_bucket").agg(F.bitmap_construct_agg("_bit").alias("ids"))


def merged_sets(sets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sets of coarser groups."""
    return sets.groupBy(*group, "id_bucket").agg(F.bitmap_or_agg("ids").alias("ids"))


def set_sizes(sets: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Number of different ids in each group, which may be coarser than that of ``sets``."""
    return merged_sets(sets, group).groupBy(*group).agg(F.sum(F.bitmap_count("ids")).cast("long").alias(name))
