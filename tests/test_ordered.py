"""Distributed ranks, places and tiles against Spark's windows over one partition; merges and readers that don't hold tables or files whole."""

import pathlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import merge, ordered, publish
from lakeloom.sources import landing, readers


def frame(spark, n, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, rnd.choice([None, 0.0, 0.0, 0.0, 1.5, rnd.random()])) for i in range(n)], "id long, v double").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_rank_and_tiles(spark, n):
    df = frame(spark, n)
    w = Window.orderBy(F.desc_nulls_last("v"))
    want = {(r["id"], r["r"]) for r in df.withColumn("r", F.rank().over(w)).collect()}
    assert {(r["id"], r["r"]) for r in ordered.ranked(df, "v", "r").collect()} == want
    want = {(r["id"], r["t"]) for r in df.withColumn("t", F.ntile(10).over(Window.orderBy(F.desc("v"), "id"))).collect()}
    assert {(r["id"], r["t"]) for r in ordered.tiles(df, [F.desc("v"), F.asc("id")], 10, "t").collect()} == want


def test_a_failed_write_leaves_the_table(spark, folder):
    path = f"{folder}/t"
    good = spark.range(10)
    assert merge.overwrite(good, path) == 10 and merge.overwrite(publish.read(spark, path).where("id < 4"), path) == 4
    with pytest.raises(Exception, match="stop"):
        merge.overwrite(good.select(F.when(F.col("id") == 9, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert sorted(r["id"] for r in publish.read(spark, path).collect()) == [0, 1, 2, 3]


def test_merge_that_looks_at_touched_partitions_only(spark, folder):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, m string, v int")
    merge.merge_partitioned(rows((1, "a", 1), (2, "b", 1)), f"{folder}/p", ["k"], ["v"], "m", keys_move=False)
    assert merge.merge_partitioned(rows((1, "a", 2), (3, "a", 1)), f"{folder}/p", ["k"], ["v"], "m", keys_move=False) == (2, ["a"])
    assert {(r["k"], r["v"]) for r in publish.read(spark, f"{folder}/p").collect()} == {(1, 2), (2, 1), (3, 1)}


def test_lines_of_split_files_keep_their_numbers(spark, folder):
    lines = [f'{{"a":{i}}}' for i in range(3000)]
    lines[1700] = "broken"
    (pathlib.Path(folder) / "x.ndjson").write_text("\n".join(lines) + "\n")
    (pathlib.Path(folder) / "y.ndjson").write_text("\n".join(lines[:5]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        parsed = readers.read_ndjson(spark, folder)
        assert parsed.rdd.getNumPartitions() >= 1 and len({r["_at"]
            for r in spark.read.text(folder).select(F.col("_metadata.file_block_start").alias("_at")).distinct().collect()}) > 3
        got = sorted((r["_source_file"][-8:], r["_row_number"], r["raw"]) for r in parsed.collect())
        assert got == sorted([("x.ndjson", i + 1, x) for i, x in enumerate(lines)] + [("y.ndjson", i + 1, x) for i, x in enumerate(lines[:5])])
        assert [r["_row_number"] for r in readers.rejects(parsed).collect()] == [1701]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_hashes_of_contents(spark, folder):
    for name, text in (("a", "1\n2\n2\n"), ("b", "1\n2\n2\n"), ("c", "1\n2\n3\n"), ("d", "1\n2\n2\n2\n")):
        (pathlib.Path(folder) / name).write_text(text)
    got = {r["source_file"][-1]: r["content_hash"] for r in landing.content_hashes(spark, folder).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3
    ledger = spark.createDataFrame([], landing.LEDGER)
    first = landing.not_yet_landed(landing.content_hashes(spark, folder), ledger, "x")
    assert sorted(r["source_file"][-1] for r in first.collect()) == ["a", "c", "d"]
