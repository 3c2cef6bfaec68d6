"""Readers of raw deliveries: every business column is text, what can't be parsed is a reject."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.sources import jsonblocks, quoted

#: Texts that count as null in CSV deliveries.
NULL_TOKENS = ("", "NULL", "null", "NaN", "nan")
#: Columns of a tracker log line, in order; other keys follow by name.
LOG_COLUMNS = ("event_ts", "level", "component", "event", "shipment_id", "order_id", "carrier", "warehouse_id", "region", "location")
LOG_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)\s+([A-Z]+)\s+\[([^\]]+)\]\s+(.*)$"
LOG_PAIR = r'([A-Za-z_][A-Za-z0-9_]*)=("[^"]*"|\S+)'


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", columns: Sequence[str] | None = None, multiline: bool | str = True) -> DataFrame:
    """All-text rows of CSV files with a header, and ``_source_file``.

    Line feeds may stand in quoted values: records are found in all splits of a file at once. ``multiline="file"`` reads each
    file by one task instead (many small files), and where no value holds a line feed ``multiline=False`` is cheapest. A file without a header and a header that names a column twice are errors.
    Only the first line is read beforehand; ``columns`` spares that.
    """
    if columns is None:
        head = spark.read.text(path).limit(1).collect()
        if not head or not head[0][0].strip():
            raise ValueError(f"{path}: no header")
        columns = [c.strip().strip('"') for c in head[0][0].lstrip("﻿").split(delimiter)]
    if len(set(columns)) != len(columns):
        raise ValueError(f"{path}: column named twice in {columns}")
    if multiline is True:
        row = F.from_csv(F.regexp_replace("record", "^\ufeff", ""), ", ".join(f"`{c}` STRING" for c in columns), {"sep": delimiter, "escape": '"'})
        wrong = F.raise_error(F.concat(F.lit("other header in "), F.col("source")))
        same = reduce(lambda a, b: a & b, [F.trim(F.col(f"row.`{c}`")).eqNullSafe(F.lit(c)) for c in columns])
        found = quoted.records(spark, path, delimiter).withColumn("row", row)
        body = found.where(F.when(~F.col("head"), F.lit(True)).when(same, F.lit(False)).otherwise(wrong.cast("boolean")))
        return body.select(*[F.when(~F.col(f"row.`{c}`").isin(*NULL_TOKENS), F.col(f"row.`{c}`")).alias(c) for c in columns], F.col("source").alias("_source_file"))
    rows = spark.read.schema(_text_schema(columns)).options(header=True, multiLine=multiline == "file", sep=delimiter, escape='"', enforceSchema=False).csv(path)
    return rows.select(*[F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in columns], F.col("_metadata.file_path").alias("_source_file"))


def _as_map(c: Column) -> Column:
    """JSON object as text values (nested ones stay JSON text); null if it is none."""
    return F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})


def read_json_document(spark: SparkSession, path: str, array_key: str, whole: bool = False) -> DataFrame:
    """Elements of the array ``array_key`` of JSON documents: ``_source_file``, ``_row_number`` (from 1), ``raw`` and ``fields`` (null for a reject).

    A file that isn't an object with that array is an error when the rows are read. Documents of any length are cut in splits; with
    ``whole`` a document is one row until it is exploded (many small files, or a key with a comma).
    """
    if not whole:
        found = jsonblocks.elements(spark, path, array_key)
        alike = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), F.lit(0)), "raw")  # as an element of a parsed array
        each = found.select(F.col("source").alias("_source_file"), F.col("nth").cast("long").alias("_row_number"), alike.alias("raw"))
        return each.withColumn("fields", _as_map(F.when(F.trim("raw").startswith("{"), F.col("raw"))))
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_source_file"), _as_map(F.col("value"))[array_key].alias("a"))
    items = F.from_json(F.coalesce("a", F.raise_error(F.concat(F.lit(f"no array {array_key!r} in "), F.col("_source_file"))).cast("string")), "array<string>")
    each = docs.select("_source_file", F.posexplode(items).alias("p", "raw"))
    return each.select("_source_file", (F.col("p") + 1).cast("long").alias("_row_number"), "raw", _as_map(F.when(F.trim("raw").startswith("{"), F.col("raw"))).alias("fields"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Lines of NDJSON files: ``_source_file``, ``_row_number`` (line, from 1), ``raw`` and ``fields`` (null for a reject). Blank lines are skipped."""
    return parse_ndjson(_numbered_lines(spark, path))


def parse_ndjson(lines: DataFrame) -> DataFrame:
    """As ``read_ndjson`` for rows with a column ``value``; other columns stay."""
    full = lines.where(F.trim("value") != "")
    return full.withColumn("fields", _as_map(F.when(F.trim("value").rlike(r"^(?s)\{.*\}$"), F.col("value")))).withColumnRenamed("value", "raw")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number in their file. Large files are read in splits.

    A line's number is its place in its split plus the lines of the file's earlier splits; these come from a first pass that keeps
    one row per split, which goes to every task, so no line is shuffled. Both passes plan the same splits, since they read the same files.
    """
    at = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_source_file"), at.alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = lines.groupBy("_source_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_source_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    number = (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("long").alias("_row_number")
    return lines.join(F.broadcast(splits), ["_source_file", "_at"]).select("_source_file", number, "value")


def good(parsed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parsed rows as text columns; a missing key is null."""
    keep = [c for c in parsed.columns if c not in ("raw", "fields")]
    return parsed.where(F.col("fields").isNotNull()).select(*[F.try_element_at("fields", F.lit(c)).alias(c) for c in columns], *keep)


def rejects(parsed: DataFrame) -> DataFrame:
    """Rows that couldn't be parsed: ``raw``, ``error`` and what identifies them."""
    keep = [c for c in parsed.columns if c != "fields"]
    return parsed.where(F.col("fields").isNull()).select(*keep, F.lit("not a JSON object").alias("error"))


def key_union(parsed: DataFrame, most: int = 10_000) -> list[str]:
    """All keys that any row has, sorted: the schema of the delivery. More than ``most`` keys are no schema (ids as keys, say) and an error."""
    keys = [r[0] for r in parsed.select(F.explode(F.map_keys("fields"))).distinct().limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} different keys")
    return sorted(keys)


def parse_log(lines: DataFrame) -> DataFrame:
    """Log lines (column ``value``) as ``raw`` and ``fields``; comments and blank lines are skipped, other columns stay.

    A line without the envelope ``<time> LEVEL [component] key=value ...`` or without ``event`` or ``shipment_id`` is a reject
    (null ``fields``). The last of equal keys counts; quotes around values go.
    """
    full = lines.where(~F.trim("value").rlike("^(#.*)?$"))
    line = F.regexp_extract("value", LOG_LINE, 4)
    pairs = F.regexp_extract_all(line, F.lit(LOG_PAIR), F.lit(0))
    pair = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, '^[^=]*="?|"$', "").alias("value"))
    last_first = F.reverse(F.transform(pairs, pair))
    distinct = F.filter(last_first, lambda e, i: F.array_position(F.transform(last_first, lambda x: x["key"]), e["key"]) == i + 1)
    envelope = F.create_map(F.lit("event_ts"), F.regexp_extract("value", LOG_LINE, 1), F.lit("level"), F.regexp_extract("value", LOG_LINE, 2),
        F.lit("component"), F.regexp_extract("value", LOG_LINE, 3))
    fields = F.map_from_entries(F.concat(F.map_entries(envelope), F.filter(distinct, lambda e: ~e["key"].isin("event_ts", "level", "component"))))
    ok = F.col("value").rlike(LOG_LINE) & F.try_element_at(F.col("_f"), F.lit("event")).isNotNull() & F.try_element_at(F.col("_f"), F.lit("shipment_id")).isNotNull()
    return full.withColumn("_f", fields).withColumn("fields", F.when(ok, F.col("_f"))).drop("_f").withColumnRenamed("value", "raw")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """As ``parse_log``, with ``_source_file`` and ``_row_number``."""
    return parse_log(_numbered_lines(spark, path))


def records_to_text(records: DataFrame, column: str, columns: Sequence[str]) -> DataFrame:
    """JSON records in ``column`` as text columns: null stays null, nested values are compact JSON, booleans true or false."""
    return records.withColumn("_m", _as_map(F.col(column))).select(*[F.try_element_at("_m", F.lit(c)).alias(c) for c in columns])


def read_partitions(spark: SparkSession, path: str, partition: str | None = None, values: Sequence[str] | None = None, one_schema: bool = False) -> DataFrame:
    """A parquet dataset, or only the given values of its partition column, which prune directories.

    Deliveries may differ in columns, so the footers of all files are read; ``one_schema`` spares that where all are alike.
    """
    rows = spark.read.option("mergeSchema", not one_schema).parquet(path)
    return rows if values is None else rows.where(F.col(partition).isin(*values))


def read_bronze(spark: SparkSession, path: str, batches: Sequence[str] | None, columns: Sequence[str]) -> DataFrame:
    """Landed rows of some batches; registered columns that a delivery lacked are null text."""
    rows = read_partitions(spark, path, "_batch_id", batches)
    return rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})
