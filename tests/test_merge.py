"""Merges: reruns, moved keys, null partitions, and the same through a file stream."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import merge, publish
from lakeloom.streaming import feeds

SCHEMA = "k long, month string, v string, version long"


def test_partitioned_merge(spark, folder):
    path = f"{folder}/t"
    first = spark.createDataFrame([(1, "2024-01", "a", 1), (2, "2024-01", "b", 1), (3, "2024-02", "c", 1)], SCHEMA)
    assert merge.merge_partitioned(first, path, ["k"], ["version"], "month") == (3, ["2024-01", "2024-02"])
    moved = spark.createDataFrame([(3, "2024-03", "c2", 2)], SCHEMA)
    assert merge.merge_partitioned(moved, path, ["k"], ["version"], "month") == (1, ["2024-02", "2024-03"])
    table = {r["k"]: (r["month"], r["v"]) for r in publish.read(spark, path).collect()}
    assert table == {1: ("2024-01", "a"), 2: ("2024-01", "b"), 3: ("2024-03", "c2")}
    older = spark.createDataFrame([(1, "2024-01", "old", 0)], SCHEMA)
    merge.merge_partitioned(older, path, ["k"], ["version"], "month")
    assert publish.read(spark, path).where("k = 1").head()["v"] == "a"


def test_null_partition_is_an_error(spark, folder):
    with pytest.raises(Exception, match="null month"):
        merge.merge_partitioned(spark.createDataFrame([(1, None, "a", 1)], SCHEMA), f"{folder}/n", ["k"], ["version"], "month")


def test_upsert_rerun_inserts_nothing(spark):
    table = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k long, v string, kept string")
    source = spark.createDataFrame([(2, "B", 1), (3, "C", 1)], "k long, v string, extra int")
    once = merge.upsert(table, source, ["k"])
    assert merge.upsert_counts(once).head().asDict() == {"read": 2, "inserted": 1, "updated": 1}
    again = merge.upsert(once.drop("_action"), source, ["k"])
    assert merge.upsert_counts(again).head().asDict() == {"read": 2, "inserted": 0, "updated": 2}
    assert merge.skipped_columns(table, source) == ["extra"]
    assert {r["k"]: (r["v"], r["kept"]) for r in once.collect()} == {1: ("a", None), 2: ("B", "x"), 3: ("C", None)}


def test_late_row_touches_later_months(spark):
    rows = spark.createDataFrame([(1, "2024-01"), (1, "2024-03"), (2, "2024-02")], "c long, m string")
    got = merge.months_from(rows, rows.where("c = 1 AND m = '2024-01'"), ["c"], "m")
    assert {r["m"] for r in got.collect()} == {"2024-01", "2024-03"}


def test_stream_merge(spark, folder):
    drop = pathlib.Path(folder) / "in"
    drop.mkdir()
    for i, text in enumerate(("1,a,1\n2,b,1\n", "1,c,2\n")):
        (drop / f"{i}.txt").write_text(text)
        lines = feeds.text_feed(spark, str(drop))
        parts = F.split("value", ",")
        rows = lines.select(parts[0].cast("long").alias("k"), parts[1].alias("v"), parts[2].cast("long").alias("version"))
        feeds.merge_stream(rows, f"{folder}/out", f"{folder}/check", ["k"], ["version"]).awaitTermination(120)
    assert {r["k"]: r["v"] for r in publish.read(spark, f"{folder}/out").collect()} == {1: "c", 2: "b"}


def table_of(spark, path):
    return sorted(map(tuple, publish.read(spark, path).select("k", "month", "v").collect()))


STEPS = [("stage", 0), ("stage", 1), ("_write_small", 0), ("_rename", 0), ("_clean", 0), ("_delete", 0)]


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step,nth", STEPS)
def test_a_merge_that_stops_anywhere_leaves_one_whole_version(spark, folder, monkeypatch, step, nth, after):
    """The writer stops before or after each of its steps: readers get the old table or the new one, the next merge goes on, leftovers go."""
    path = f"{folder}/t"
    for v in (1, 2):
        merge.merge_partitioned(spark.createDataFrame([(k, f"2024-0{1 + k % 4}", f"v{v}", v) for k in range(20)], SCHEMA), path, ["k"], ["version"], "month")
    before = table_of(spark, path)
    new = spark.createDataFrame([(k, f"2024-0{1 + (k + 1) % 4}", "v3", 3) for k in range(5)], SCHEMA)
    own, calls = getattr(publish, step), []

    def stops(*args, **named):
        calls.append(1)
        if len(calls) != nth + 1:
            return own(*args, **named)
        if after:
            own(*args, **named)
        raise OSError("stop")

    monkeypatch.setattr(publish, step, stops)
    with pytest.raises(OSError, match="stop"):
        merge.merge_partitioned(new, path, ["k"], ["version"], "month")
    monkeypatch.undo()
    done = sorted([(k, m, v) for k, m, v in before if k >= 5] + [(k, f"2024-0{1 + (k + 1) % 4}", "v3") for k in range(5)])
    published = step in ("_clean", "_delete") or step == "_rename" and after
    assert table_of(spark, path) == (done if published else before)
    merge.merge_partitioned(new, path, ["k"], ["version"], "month")
    assert table_of(spark, path) == done
    publish.vacuum(spark, path)
    assert table_of(spark, path) == done and publish.vacuum(spark, path) == 0


def test_two_writers_of_one_version(spark, folder):
    path = f"{folder}/t"
    merge.overwrite(spark.range(3), path)
    seen = publish.manifest(spark, path)
    merge.overwrite(spark.range(4), path)
    with pytest.raises(OSError, match="another writer"):
        publish.publish(spark, path, seen, parts={})
    assert publish.read(spark, path).count() == 4


def test_readers_of_the_last_version_finish(spark, folder):
    path = f"{folder}/t"
    merge.overwrite(spark.range(3), path)
    slow = publish.read(spark, path)
    merge.overwrite(spark.range(4), path)
    assert slow.count() == 3
    merge.overwrite(spark.range(5), path)
    assert len(list(pathlib.Path(path, "data").iterdir())) == 2 and publish.read(spark, path).count() == 5


def test_moved_keys_are_found_by_the_index(spark, folder):
    path = f"{folder}/t"
    key = ["k", "part"]
    schema = "k long, part string, month string, version long"
    rows = [(k, None if k % 5 == 0 else f"p{k % 3}", f"2024-{1 + k % 12:02d}", 1) for k in range(600)]
    merge.merge_partitioned(spark.createDataFrame(rows, schema), path, key, ["version"], "month")
    folders = publish.manifest(spark, path)["index"]["folders"]
    assert len(folders) == merge.INDEX_BUCKETS
    one = spark.createDataFrame([(10, None, "2025-01", 2), (700, "p1", "2025-01", 2)], schema)
    n, touched = merge.merge_partitioned(one, path, key, ["version"], "month")
    assert touched == ["2024-11", "2025-01"] and n == 51
    now = publish.manifest(spark, path)
    assert 1 <= sum(now["index"]["folders"][b] != f for b, f in folders.items()) <= 2  # other buckets were not read or written
    back = spark.createDataFrame([(10, None, "2024-02", 3), (700, "p1", "2025-02", 1)], schema)  # moves again; the older row doesn't
    assert merge.merge_partitioned(back, path, key, ["version"], "month")[1] == ["2024-02", "2025-01", "2025-02"]
    got = {(r["k"], r["month"]) for r in publish.read(spark, path).collect()}
    assert got == {(k, m) for k, _, m, _ in rows if k != 10} | {(10, "2024-02"), (700, "2025-01")}
    index = publish.manifest(spark, path)["index"]["folders"].values()
    kept = publish.read_folders(spark, path, index, "k long, part string, _part string")
    assert {(r["k"], r["_part"]) for r in kept.collect()} == got and kept.count() == len(got)
    only = publish.read(spark, path, ["2024-02"])
    assert {f.split("part_=")[1].split("/")[0] for f in only.inputFiles()} == {"2024-02"}
    merge.overwrite_partitions(publish.read(spark, path, ["2024-03"]), path, "month")  # writes without the index: made again by the next merge
    assert publish.manifest(spark, path)["index"] is None
    assert merge.merge_partitioned(spark.createDataFrame([(1, "p1", "2025-03", 9)], schema), path, key, ["version"], "month")[1] == ["2024-02", "2025-03"]


def test_columns_of_one_text_are_added_behind_the_shuffle(spark, folder):
    """A first merge doesn't shuffle them; one into a table that holds other texts keeps each row's own."""
    new = lambda b, ids, v: spark.createDataFrame([(i, b, f"p{i % 2}", v) for i in ids], "k int, _batch string, p string, v int")
    for batch, ids, v in (("b1", range(6), 1), ("b2", range(4, 9), 2)):
        merge.merge_partitioned(new(batch, ids, v), f"{folder}/t", ["k"], ["v"], "p", fixed={"_batch": batch, "p": "not used: it is the partition"})
    got = publish.read(spark, f"{folder}/t")
    assert got.columns == ["k", "_batch", "p", "v"]
    assert sorted(map(tuple, got.collect())) == [(i, "b1" if i < 4 else "b2", f"p{i % 2}", 1 if i < 4 else 2) for i in range(9)]


def test_index_is_written_without_a_shuffle(spark, folder):
    rows = spark.range(100).selectExpr("id", "id % 3 AS p").repartition(3)
    parts, n = publish.stage(rows, f"{folder}/t", F.col("p").cast("string"), gathered=False)
    files = [f for p in parts.values() for f in os.listdir(f"{folder}/t/{p}") if f.endswith(".parquet")]
    assert (sorted(parts), n, len(files)) == (["0", "1", "2"], 100, 9)
    assert sorted(r["id"] for r in publish.read_folders(spark, f"{folder}/t", parts.values(), rows.schema).collect()) == list(range(100))
