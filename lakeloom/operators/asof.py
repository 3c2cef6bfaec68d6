"""As-of join: each row meets the newest one at or before it, by a merge of both sides in order of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.prefix import scan


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """Every row of ``left`` with ``values`` of the row of ``right`` that agrees in all of ``by`` and is the newest with ``right_at`` not after ``left_at``; null
    where there is none.

    Both sides go through one scan in order of time, the right one first where times are equal; neither is widened to a grid and no pair is
    made that isn't returned. A key of any size covers several partitions. Null keys and times meet nothing. Of right rows that agree in key and
    time the greatest by ``values`` counts; a null among its values is returned as such.
    """
    if clash := set(values) & set(left.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    keys = [f"_asof_key{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    brought = F.struct(*[F.col(v).alias(v) for v in values])
    known = right.dropna(subset=[*by, right_at]).select(*named, F.col(right_at).alias("_asof_at"), brought.alias("_asof_value"))
    known = known.groupBy(*keys, "_asof_at").agg(F.max("_asof_value").alias("_asof_value")).withColumn("_asof_asks", F.lit(False))
    row = F.struct(*[F.col(c).alias(c) for c in left.columns])
    asked = left.select(*named, F.col(left_at).alias("_asof_at"), row.alias("_asof_row"), F.lit(True).alias("_asof_asks"))
    both = known.unionByName(asked, allowMissingColumns=True)
    met = scan(both, keys, ["_asof_at", "_asof_asks"], lasts={"_asof_value": F.col("_asof_value")}).where("_asof_asks")
    return met.select("_asof_row.*", *[F.col("_asof_value")[v].alias(v) for v in values])
