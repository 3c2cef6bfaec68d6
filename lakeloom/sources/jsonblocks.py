"""Elements of an array in a JSON document of any length, cut in all splits of the file at once.

Text is read in pieces between commas. What a piece means depends on all text before it, by three things: whether it begins inside a string, how deep,
and whether that is in the wanted array. Each is a step that can be joined, so running joins over the splits of a file (one row per split) give
what every split begins with; a last pass cuts elements, and those that cross splits are put together from their pieces.
"""

from __future__ import annotations

import json
import re
import sys
from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A string with its end or without, or a bracket; the rest of a string that has begun before.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{}]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)


def _is(token: str, key: str) -> bool:
    """Whether a quoted string is ``key``."""
    if "\\" not in token:
        return token[1:-1] == key
    try:
        return json.loads(token, strict=False) == key
    except ValueError:
        return False


def scan(text: str, inside: bool, depth: int, key: str | None = None, within: bool = False) -> tuple[bool, int, bool, list[tuple[int, bool]]]:
    """(inside, depth, within, events) after a piece: events are the places behind the bracket that opens the array ``key`` of the outermost
    object (True), and of the one that closes it (False)."""
    at, events, before = 0, [], ""
    if inside:
        m = _REST.match(text)
        at, inside = m.end(), not m[1]
    for m in _TOKEN.finditer(text, at):
        c = m[0]
        if c[0] == '"':
            inside, before = not m[1], c
        elif c in "[{":
            if key is not None and c == "[" and depth == 1 and _is(before, key) and text[: m.start()].rstrip().endswith(":"):
                events.append((m.end(), True))
                within = True
            depth += 1
        else:
            depth -= 1
            if within and depth == 1:
                events.append((m.start(), False))
                within = False
    return inside, depth, within, events


def _rows(batches, *names):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("source", "at", "value", *names)], strict=True)


def _out(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])


_PLACE = [("source", pa.string()), ("at", pa.int64())]


def _steps(batches):
    """Of each split: string state and change of depth at its end, if it begins outside a string, and inside one."""
    schema = [*_PLACE, ("out", pa.bool_()), ("within", pa.bool_()), ("out_depth", pa.int64()), ("within_depth", pa.int64())]
    key, now = None, ((False, 0), (True, 0))
    for file, at, text in _rows(batches):
        if (file, at) != key:
            if key is not None:
                yield _out([(*key, now[0][0], now[1][0], now[0][1], now[1][1])], schema)
            key, now = (file, at), ((False, 0), (True, 0))
        now = tuple(scan(text, s, d)[:2] for s, d in now)
    if key is not None:
        yield _out([(*key, now[0][0], now[1][0], now[0][1], now[1][1])], schema)


def _events(batches, name: str):
    """Of each split: whether the array is open at its end, null if nothing happens to it there; how often it begins; and the depth at the end."""
    schema = [*_PLACE, ("open", pa.bool_()), ("begins", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64())]
    key, open_, begins, state = None, None, 0, (False, 0)
    for file, at, text, inside, depth in _rows(batches, "inside", "depth"):
        if (file, at) != key:
            if key is not None:
                yield _out([(*key, open_, begins, *state)], schema)
            key, open_, begins, state = (file, at), None, 0, (inside, depth)
        # a bracket that brings depth 2 to 1 closes the array if it is open: taken as open here, which is harmless where it isn't
        *state, _, events = scan(text, *state, name, open_ is not False)
        state = tuple(state)
        for _, opens in events:
            open_, begins = opens, begins + opens
    if key is not None:
        yield _out([(*key, open_, begins, *state)], schema)


def _elements(batches, name: str):
    """Pieces of elements: ``nth`` in the split, whether it came from the split before, and whether it goes on in the next."""
    schema = [*_PLACE, ("nth", pa.int64()), ("came", pa.bool_()), ("goes_on", pa.bool_()), ("raw", pa.string())]
    key, held, out = None, [], []
    nth, came, within, state = 0, False, False, (False, 0)

    def put(goes_on: bool) -> None:
        nonlocal nth, came
        out.append((*key, nth, came, goes_on, ",".join(held)))
        nth, came = nth + 1, False
        held.clear()

    for file, at, text, inside, depth, open_ in _rows(batches, "inside", "depth", "open"):
        if (file, at) != key:
            if held:
                put(True)
            key, nth, within, state = (file, at), 0, open_, (inside, depth)
            came = open_ and (inside or depth > 2)  # else an element has ended with the comma before
        was, begin = within, 0
        inside_, depth_, within, events = scan(text, *state, name, within)
        state = (inside_, depth_)
        for place, opens in events:
            if not opens:
                held.append(text[begin:place])
                put(False)
            was, begin = opens, place
        if was:
            held.append(text[begin:])
            if not inside_ and depth_ == 2:
                put(False)
        if len(out) >= 10_000:
            yield _out(out, schema)
            out = []
    if held:
        put(True)
    if out:
        yield _out(out, schema)


def elements(spark: SparkSession, path: str, array_key: str) -> DataFrame:
    """Elements of the array ``array_key`` of each document: ``source``, ``nth`` (from 1) and ``raw`` (JSON text).

    A document that ends within a string or an object, or has no such array (of two, both count), is an error when rows are read. Text stays where it is read; only
    pieces of elements that cross splits are shuffled. The key may hold no comma.
    """
    if "," in array_key:
        raise ValueError(f"a key with a comma: {array_key!r}")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this module
    text = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("at"), "value")
    order = Window.partitionBy("source").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    steps = text.mapInArrow(_steps, "source string, at bigint, out boolean, within boolean, out_depth bigint, within_depth bigint")
    turns = F.when(F.col("out") & ~F.col("within"), 1).otherwise(0)
    steps = steps.withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("fixed", F.when(F.col("out") == F.col("within"), F.struct(F.col("out").cast("int").alias("to"), "turned")))
    last, turned = F.last("fixed", ignorenulls=True).over(before), F.coalesce(F.lag("turned").over(order), F.lit(0))
    bit = F.when(last.isNull(), turned % 2).otherwise((last["to"] + turned - last["turned"]) % 2)
    begun = steps.withColumn("inside", bit == 1)
    gained = F.when(F.col("inside"), F.col("within_depth")).otherwise(F.col("out_depth"))
    states = begun.withColumn("depth", F.coalesce(F.sum(gained).over(before), F.lit(0))).select("source", "at", "inside", "depth")
    placed = text.join(F.broadcast(states), ["source", "at"])  # one row per split
    events = placed.mapInArrow(partial(_events, name=array_key), "source string, at bigint, open boolean, begins bigint, inside boolean, depth bigint")
    end = F.max(F.struct("at", "inside", "depth"))
    files = events.groupBy("source").agg(F.sum("begins").alias("begins"), end.alias("end"))
    whole = (F.col("begins") > 0) & ~F.col("end.inside") & (F.col("end.depth") == 0)
    checked = files.select("source", F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no array {array_key!r} in "), F.col("source"))).cast("boolean")).alias("ok"))
    opened = events.select("source", "at", F.coalesce(F.last("open", ignorenulls=True).over(before), F.lit(False)).alias("open"))
    opened = opened.join(checked, "source").where("ok").drop("ok")
    cut = placed.join(F.broadcast(opened), ["source", "at"]).mapInArrow(partial(_elements, name=array_key),
        "source string, at bigint, nth bigint, came boolean, goes_on boolean, raw string")
    pieces = cut.where("came OR goes_on").withColumn("first", F.when(~F.col("came"), F.struct("at", "nth")))
    pieces = pieces.withColumn("first", F.last("first", ignorenulls=True).over(Window.partitionBy("source").orderBy("at", "nth")))
    joined = pieces.groupBy("source", F.col("first.at").alias("at"), F.col("first.nth").alias("nth")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "raw"))), lambda p: p["raw"]), ",").alias("raw"))
    found = cut.where("NOT came AND NOT goes_on").select("source", "at", "nth", "raw").unionByName(joined)
    found = found.withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("raw <> ''")
    counts = found.groupBy("source", "at").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("least"))
    ahead = counts.select("source", "at", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return found.join(F.broadcast(ahead), ["source", "at"]).select("source", (F.col("ahead") + F.col("nth") - F.col("least") + 1).alias("nth"), "raw")  # one row per split
