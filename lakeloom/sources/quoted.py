"""Records of delimited text whose quoted values may hold line feeds, found in all splits of a file at once.

Whether a line begins inside a quoted value depends on all lines before it, but only by one bit. Each split is read once for both cases: it
keeps the bit, turns it, or ends in a state of its own. Such steps can be joined, so a running join over the splits of a file (one row per split)
gives the bit that each split begins with. A second pass cuts records; those that cross a split are put together from their pieces.
"""

from __future__ import annotations

import sys
from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def after_line(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted value is open after ``line``, which begins inside one or not. A quote opens a value only as its first character, and
    two quotes in a value are one; what follows a closing quote up to the separator belongs to the value."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                if at == n:
                    return False
                continue
            at += 1
        while True:  # in a value: to its closing quote
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('"', at + 1):
                break
            at += 2
        inside = False
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at += len(sep)


def _pieces(batches):
    """Consecutive lines of one split of one file: (file, start of the split, column batches' lines and further columns)."""
    for batch in batches:
        files, starts = batch.column("source").to_pylist(), batch.column("at").to_pylist()
        lines = batch.column("value").to_pylist()
        opens = batch.column("inside").to_pylist() if "inside" in batch.schema.names else [False] * len(lines)
        yield from zip(files, starts, lines, opens, strict=True)


def _steps(batches, sep: str):
    """What each split does to the bit: the state that it ends in from outside, and from inside."""
    key, ends = None, (False, True)

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([ends[0]]), pa.array([ends[1]])], ["source", "at", "out", "within"])

    for file, at, line, _ in _pieces(batches):
        if (file, at) != key:
            if key is not None:
                yield row()
            key, ends = (file, at), (False, True)
        if '"' in line:
            step = {s: after_line(line, s, sep) for s in set(ends)}
            ends = (step[ends[0]], step[ends[1]])
    if key is not None:
        yield row()


def _records(batches, sep: str):
    """Records of each split: ``whole`` ones, and pieces that go on in the next split or come from the one before; ``nth`` counts within the split."""
    key, inside, held, nth, came, headed = None, False, [], 0, False, True
    out: list[tuple] = []

    def put(goes_on: bool) -> None:
        nonlocal nth, came, headed
        text = "\n".join(held)
        head = not headed and not goes_on and text not in ("", "\r")
        headed = headed or head
        out.append((key[0], key[1], nth, came, goes_on, head, text))
        nth += 1
        came = False
        held.clear()

    def batch_of():
        cols = [list(c) for c in zip(*out, strict=True)]
        out.clear()
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["source", "at", "nth", "came", "goes_on", "head", "record"])

    for file, at, line, begins in _pieces(batches):
        if (file, at) != key:
            if held:
                put(True)
            key, inside, nth, came, headed = (file, at), begins, 0, begins, at > 0
        held.append(line)
        inside = after_line(line, inside, sep) if '"' in line else inside
        if not inside:
            put(False)
        if len(out) >= 10_000:
            yield batch_of()
    if held:
        put(True)
    if out:
        yield batch_of()


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Records of delimited text files, large ones in splits: ``source`` (file), ``at`` (first byte of the split where it begins), ``nth`` (in that split), ``head`` (the first record of a file) and ``record``.

    Lines end with a line feed, carriage returns before it go; records without a character are left out. Lines stay where they are
    read; only pieces of records that cross splits, at most two a split, are shuffled.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this module
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("at"), "value")
    steps = lines.mapInArrow(partial(_steps, sep=sep), "source string, at bigint, out boolean, within boolean")
    order = Window.partitionBy("source").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("out") & ~F.col("within"), 1).otherwise(0)
    fixed = F.when(F.col("out") == F.col("within"), F.struct(F.col("out").cast("int").alias("to"), F.col("turned")))
    known = steps.withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("fixed", fixed)
    last, turned = F.last("fixed", ignorenulls=True).over(before), F.coalesce(F.lag("turned").over(order), F.lit(0))
    bit = F.when(last.isNull(), turned % 2).otherwise((last["to"] + turned - last["turned"]) % 2)
    inside = known.select("source", "at", (bit == 1).alias("inside")).where("inside")  # one row for each split that begins in a value
    begun = lines.join(F.broadcast(inside), ["source", "at"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    cut = begun.mapInArrow(partial(_records, sep=sep), "source string, at bigint, nth bigint, came boolean, goes_on boolean, head boolean, record string")
    pieces = cut.where("came OR goes_on").withColumn("first", F.when(~F.col("came"), F.struct("at", "nth")))
    pieces = pieces.withColumn("first", F.last("first", ignorenulls=True).over(Window.partitionBy("source").orderBy("at", "nth")))
    joined = pieces.groupBy("source", F.col("first.at").alias("at"), F.col("first.nth").alias("nth")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "record"))), lambda p: p["record"]), "\n").alias("record"))
    whole = cut.where("NOT came AND NOT goes_on").select("source", "at", "nth", "head", "record").unionByName(joined.withColumn("head", F.lit(False)))
    return whole.withColumn("record", F.regexp_replace(F.regexp_replace("record", "\r$", ""), "\r\n", "\n")).where("record <> ''")
