"""Prefix scans within groups of any size, and exact percentiles from them: no group is sorted in one task.

Rows lie in range partitions of (group, order), so that a large group covers several. Each partition scans its own stretch of a group; what
a stretch takes over from earlier ones is a row for each partition that begins inside a group. The windows of ``windows`` give the
same rows and are for groups of a known bound, such as days of a calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.scratch import written

#: Parts over which the rows of a group meet the size of their group.
SPREAD = 16


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of all ``columns``; nulls are equal."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[f"_of_{c}"])
    return out


def scan(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None,
         lasts: Mapping[str, Column] | None = None, previous: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its value up to and with the row (null until there is a value); in ``lasts``, the last value up
    to and with the row that isn't null; in ``previous``, the value of the row before.

    ``group`` and ``order`` are columns, nulls are equal and come first. ``order`` should be unique in a group; rows that tie follow each other in any order.
    A name may be that of a column, which it replaces.
    """
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    ranged = df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part", *group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"_at": F.row_number().over(w)}
    local |= {f"_sum_{k}": F.sum(v).over(upto) for k, v in sums.items()}
    local |= {f"_last_{k}": F.last(v, ignorenulls=True).over(upto) for k, v in lasts.items()}
    for k, v in previous.items():
        local |= {f"_own_{k}": v, f"_prev_{k}": F.lag(v).over(w)}
    held = written(ranged.select("*", *[v.alias(k) for k, v in local.items()]), "scan")

    ends = [c for c in local if not c.startswith("_prev_")]  # the last row of a stretch has all that the next one takes over
    stretches = held.groupBy("_part", *group).agg(F.max_by(F.struct(*ends), "_at").alias("_end"))
    by_part = Window.partitionBy(*group).orderBy("_part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    taken = [F.sum(f"_end._sum_{k}").over(earlier).alias(f"_from_{k}") for k in sums]
    taken += [F.last(f"_end._last_{k}", ignorenulls=True).over(earlier).alias(f"_from_{k}") for k in lasts]
    taken += [F.lag(f"_end._own_{k}").over(by_part).alias(f"_from_{k}") for k in previous]
    named = [F.col(c).alias(f"_of_{c}") for c in group]
    carried = stretches.select(F.col("_part").alias("_to"), *named, F.row_number().over(by_part).alias("_nth"), *taken).where("_nth > 1").drop("_nth")
    met = held.join(F.broadcast(carried), (held["_part"] == carried["_to"]) & _same(held, carried, group), "left")  # a partition begins in one group: one row each

    out = {}
    for k in sums:
        own, before = F.col(f"_sum_{k}"), F.col(f"_from_{k}").cast(held.schema[f"_sum_{k}"].dataType)
        out[k] = F.coalesce(own + before, own, before).cast(held.schema[f"_sum_{k}"].dataType)
    out |= {k: F.coalesce(f"_last_{k}", f"_from_{k}") for k in lasts}
    out |= {k: F.when(F.col("_at") == 1, F.col(f"_from_{k}")).otherwise(F.col(f"_prev_{k}")) for k in previous}
    kept = [out.pop(c).alias(c) if c in out else held[c] for c in df.columns]
    return met.select(*kept, *[v.alias(k) for k, v in out.items()])


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with the row."""
    return scan(df, group, order, sums={name: F.col(value)})


def forward_fill(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``value``, or the last one before it that isn't null."""
    return scan(df, group, order, lasts={value: F.col(value)})


def sequence_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, day: str | None = None) -> DataFrame:
    """Number of the row in its group from 1; with ``day``, days since the previous row's."""
    since = f"days_since_prev_{name}"
    out = scan(df, group, order, sums={name: F.lit(1)}, previous={since: F.col(day)} if day else None)
    out = out.withColumn(name, F.col(name).cast("int"))
    return out.withColumn(since, F.datediff(F.col(day), F.col(since))) if day else out


def percentiles(counted: DataFrame, group: Sequence[str], value: str, count: str, named: Mapping[str, float], beside: Sequence[Column] = ()) -> DataFrame:
    """Exact percentiles of each group, interpolated as ``F.percentile`` does, from ``counted``: rows (unique by group and value) with a ``count``.

    A percentile is picked by rank: running counts in order of value say which value stands at a place, so a task holds counters and no set of values. The
    rows of a group meet its size in ``SPREAD`` parts. Null values don't count; a group without others has null percentiles. ``beside`` are
    further aggregates of ``counted``, taken in the same pass.
    """
    rows = counted.withColumn("_rows", F.when(F.col(value).isNotNull(), F.coalesce(count, F.lit(0))).otherwise(0).cast("long"))
    upto = scan(rows, group, [value], sums={"_upto": F.col("_rows")}).withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SPREAD)).cast("int"))
    sizes = upto.groupBy(*group).agg(F.max("_upto").alias("_size")).select(*[F.col(c).alias(f"_of_{c}") for c in group], "_size",
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_salt_of"))
    met = upto.join(sizes, (upto["_salt"] == sizes["_salt_of"]) & _same(upto, sizes, group))

    def stands(at: Column) -> Column:
        """The value at a place from 0."""
        return F.max(F.when((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_rows")), F.col(value).cast("double")))

    picked = []
    for i, p in enumerate(named.values()):
        at = (F.col("_size") - 1) * F.lit(float(p))
        picked += [stands(F.floor(at)).alias(f"_lo{i}"), stands(F.ceil(at)).alias(f"_hi{i}")]
    picks = met.groupBy(*group).agg(F.max("_size").alias("_size"), *picked, *beside)

    def between(i: int, p: float) -> Column:
        at, lo, hi = (F.col("_size") - 1) * F.lit(float(p)), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    found = picks.select("*", *[between(i, p).alias(name) for i, (name, p) in enumerate(named.items())])
    return found.drop("_size", *[f"_{end}{i}" for i in range(len(named)) for end in ("lo", "hi")])
