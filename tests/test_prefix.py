"""Scans, percentiles and sets of ids against Spark's windows and aggregates, with a group that holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import distinct, prefix, windows


def frame(spark, n, seed=3):
    """A hot group, a null group and small ones; nulls among the values."""
    rnd = random.Random(seed)
    groups = ["hot"] * 6 + [None, "a", "b", "c"]
    rows = [(i, rnd.choice(groups), rnd.choice([None, None, rnd.randrange(-50, 50)]), f"2024-01-{1 + i % 28:02d}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v int, d string").select("id", "g", "v", F.to_date("d").alias("d")).repartition(3)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("n", [0, 1, 9, 2000])
def test_scans_equal_windows(spark, n):
    df = frame(spark, n)
    assert rows(prefix.running_sum(df, ["g"], ["id"], "v", "s"), "id", "g", "v", "s") == rows(windows.running_sum(df, ["g"], ["id"], "v", "s"), "id", "g", "v", "s")
    assert rows(prefix.forward_fill(df, ["g"], ["id"], "v"), "id", "v") == rows(windows.forward_fill(df, ["g"], ["id"], "v"), "id", "v")
    got, want = (m.sequence_in_group(df, ["g"], ["d", "id"], "seq", "d") for m in (prefix, windows))
    assert got.columns == want.columns and got.dtypes == want.dtypes and rows(got, *got.columns) == rows(want, *want.columns)


def test_running_sum_of_decimals_keeps_its_type(spark):
    df = frame(spark, 300).withColumn("v", F.col("v").cast("decimal(12,2)"))
    got, want = (m.running_sum(df, ["g"], ["id"], "v", "s") for m in (prefix, windows))
    assert got.dtypes == want.dtypes and rows(got, "id", "s") == rows(want, "id", "s")


def test_a_hot_group_lies_in_several_partitions(spark, monkeypatch):
    kept = {}
    real = prefix.written
    monkeypatch.setattr(prefix, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        df = frame(spark, 4000)
        got = prefix.running_sum(df, ["g"], ["id"], "v", "s")
        assert rows(got, "id", "s") == rows(windows.running_sum(df, ["g"], ["id"], "v", "s"), "id", "s")
        sizes = [r["count"] for r in kept["scan"].where("g = 'hot'").groupBy("_part").count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 0.7 * sum(sizes)
    finally:
        spark.conf.set(conf, old)


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1500])
def test_percentiles_equal_those_of_spark(spark, n):
    df = frame(spark, n).withColumn("x", F.col("v") / 8)
    counted = df.groupBy("g", "x").agg(F.count("x").alias("n"))
    points = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "p90": 0.9, "p99": 0.99, "hi": 1.0}
    want = df.groupBy("g").agg(*[F.percentile("x", p).alias(k) for k, p in points.items()])
    got = prefix.percentiles(counted, ["g"], "x", "n", points, [F.sum("n").alias("rows")])
    assert {r["g"]: tuple(r[c] for c in want.columns[1:]) for r in got.collect()} == {r["g"]: tuple(r)[1:] for r in want.collect()}
    assert {r["g"]: r["rows"] for r in got.collect()} == {r["g"]: r["rows"] for r in df.groupBy("g").agg(F.count("x").alias("rows")).collect()}


def test_percentiles_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", None, 3), ("b", None, 0), ("b", 2.0, 1)], "g string, x double, n long")
    got = prefix.percentiles(df, ["g"], "x", "n", {"mid": 0.5})
    assert sorted(map(tuple, got.collect())) == [("a", None), ("b", 2.0)]


def test_sets_of_ids_add_up(spark):
    rnd = random.Random(5)
    ids = [0, 1, 32767, 32768, 32769, 70000, 99999, None] + list(range(200, 260))
    df = spark.createDataFrame([(rnd.randrange(30), rnd.choice(ids)) for _ in range(3000)], "day int, id long").withColumn("week", F.floor(F.col("day") / 7)).repartition(4)
    days = distinct.id_sets(df, ["week", "day"], "id")
    for group in (["week", "day"], ["week"], []):
        want = df.groupBy(*group).agg(F.countDistinct("id").alias("n"))
        assert rows(distinct.set_sizes(days, group, "n"), *group, "n") == rows(want, *group, "n")
    assert distinct.set_sizes(distinct.id_sets(df.where("id IS NULL"), ["day"], "id"), ["day"], "n").count() == 0


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "a", "b"]], "id string")
    assert sorted(map(tuple, distinct.dense_ids(df, "id", "n").collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_group_of_one_key_is_bounded_by_counters(spark):
    df = spark.range(5000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 5003).alias("x"))
    got = prefix.percentiles(df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")), ["g"], "x", "n", {"mid": 0.5, "p95": 0.95}).first()
    want = df.groupBy("g").agg(F.percentile("x", 0.5).alias("mid"), F.percentile("x", 0.95).alias("p95")).first()
    assert tuple(got) == tuple(want)
    w = Window.partitionBy("g").orderBy("x")
    assert prefix.sequence_in_group(df, ["g"], ["x"], "i").agg(F.sum("i")).first()[0] == df.withColumn("i", F.row_number().over(w)).agg(F.sum("i")).first()[0]
