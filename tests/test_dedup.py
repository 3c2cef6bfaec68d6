"""Exact duplicates by fingerprints against a window over whole rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import dedup


def rows(df):
    return sorted(map(str, df.collect()))


def plain(df, columns, first_by):
    order = Window.partitionBy(*columns).orderBy(*first_by)
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def frame(spark, n):
    """Nulls that change places, zeros of both signs, and one row that is a third of all."""
    rnd = random.Random(n)
    kinds = [("hot", 1.0, 1)] * 20 + [(None, 1.0, 1), ("a", None, 1), ("a", 1.0, None), (None, None, None), ("z", 0.0, 0), ("z", -0.0, 0)]
    some = [(*(rnd.choice(kinds) if rnd.random() < 0.5 else (f"x{rnd.randrange(n * 3)}", rnd.random(), i)), i) for i in range(n)]
    return spark.createDataFrame(some, "a string, b double, c int, i int").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 800])
@pytest.mark.parametrize("way", ["broadcast", "shuffle", "one fingerprint"])
def test_exact_duplicates(spark, monkeypatch, n, way):
    if way == "shuffle":
        monkeypatch.setattr(dedup, "AT_ONCE", -1)
    if way == "one fingerprint":
        monkeypatch.setattr(dedup, "_fingerprint", lambda columns: {"_fp1": F.lit(1).cast("long"), "_fp2": F.lit(2).cast("long")})
    df = frame(spark, n)
    got = dedup.drop_exact_duplicates(df, ["a", "b", "c"], ["i"])
    assert got.columns == df.columns and rows(got) == rows(plain(df, ["a", "b", "c"], ["i"]))


def test_rows_that_stand_alone_are_not_shuffled(spark, folder):
    frame(spark, 500).write.parquet(f"{folder}/t")
    plan = dedup.drop_exact_duplicates(spark.read.parquet(f"{folder}/t"), ["a", "b", "c"], ["i"])._jdf.queryExecution().executedPlan().toString()
    alone = plan[: plan.index("LeftSemi")]
    assert "BroadcastHashJoin" in alone and "LeftAnti" in alone and plan.count("hashpartitioning") == 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("at_once", [1_000_000, -1])
def test_latest_of_few(spark, monkeypatch, folder, at_once):
    monkeypatch.setattr(dedup, "AT_ONCE", at_once)
    frame(spark, 500).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    got = dedup.keep_latest_of_few(df, ["a", "c"], ["b", "i"])
    assert got.columns == df.columns and rows(got) == rows(dedup.keep_latest(df, ["a", "c"], ["b", "i"]))
