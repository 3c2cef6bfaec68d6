"""Window operators over keyed, ordered rows, for groups of a known bound (an order, days of a calendar); ``prefix`` has those for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, day: str | None = None) -> DataFrame:
    """Number of the row in its group from 1; with ``day``, days since the previous row's."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out.withColumn(f"days_since_prev_{name}", F.datediff(F.col(day), F.lag(day).over(w))) if day else out


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with the row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def forward_fill(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``value``, or the last one before it that isn't null."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def rolling_mean(df: DataFrame, order: str, value: str, rows: int, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``rows`` rows; null until there are so many."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(1 - rows, 0)
    total = F.sum(value).over(w).cast("double")
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == rows, total / rows))


def change_from_previous(df: DataFrame, order: str, value: str, previous: str, growth: str, group: Sequence[str] = ()) -> DataFrame:
    """Previous row's value, and relative growth where that is positive."""
    w = Window.partitionBy(*group).orderBy(order)
    out = df.withColumn(previous, F.lag(value).over(w))
    return out.withColumn(growth, F.when(F.col(previous) > 0, (F.col(value) - F.col(previous)).cast("double") / F.col(previous).cast("double")))


def share_of_group(df: DataFrame, group: Sequence[str], value: str, total: str, share: str) -> DataFrame:
    """Sum over the group, and the row's part of it (null where the sum is 0)."""
    out = df.withColumn(total, F.sum(value).over(Window.partitionBy(*group)))
    return out.withColumn(share, F.when(F.col(total) != 0, F.col(value).cast("double") / F.col(total).cast("double")))


def days(df: DataFrame, first: Column, last: Column, name: str = "day") -> DataFrame:
    """One row per day between two dates of a one-row frame."""
    return df.select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(name))


def dense_rates(rates: DataFrame, day: str, currency: str, rate: str, base: str) -> DataFrame:
    """A rate for every day from the first to the last one given and every currency: gaps take the last rate before.

    The grid of days and currencies is small by nature; the base currency is always 1.
    """
    bounds = rates.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    grid = days(bounds, F.col("lo"), F.col("hi"), day).crossJoin(F.broadcast(rates.select(currency).distinct()))
    filled = forward_fill(grid.join(rates, [day, currency], "left"), [currency], [day], rate)
    one = F.lit("1").cast(rates.schema[rate].dataType)
    return filled.withColumn(rate, F.when(F.col(currency) == base, one).otherwise(F.col(rate)))
