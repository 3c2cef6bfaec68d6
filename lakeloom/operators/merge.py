"""Merges into keyed tables: snapshots, touched partitions only, upserts with counts, look-back increments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import publish
from lakeloom.operators.dedup import keep_latest

#: Buckets of a key index: a merge reads and rewrites those that its keys fall into. More for larger tables.
INDEX_BUCKETS = 16


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union in which a column that one side lacks is null."""
    return a.unionByName(b, allowMissingColumns=True)


#: What takes the newest row of each key: rows, keys, version.
Newest = Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]


def merged(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], version: Sequence[str], newest: Newest = keep_latest) -> DataFrame:
    """Newest row of each key of both."""
    return newest(new if existing is None else union_by_name(existing, new), keys, version)


def overwrite(df: DataFrame, path: str) -> int:
    """Replace a dataset, also one that ``df`` reads; returns the number of rows, observed during the write.

    Written once, beside the table, and published when it is complete; a write that fails anywhere leaves the table as it was.
    """
    spark = df.sparkSession
    old = publish.manifest(spark, path)
    parts, rows = publish.stage(df, path)
    publish.publish(spark, path, old, parts=parts, schema=publish.fields(None, df), index=None)
    return rows


def _part(partition: str) -> Column:
    return F.coalesce(F.col(partition).cast("string"), F.raise_error(F.lit(f"null {partition}")).cast("string"))


def overwrite_partitions(df: DataFrame, path: str, partition: str, emptied: Sequence[str] = ()) -> int:
    """Replace only the partitions that ``df`` has rows of, and drop those in ``emptied`` that it has none of.

    A null partition value is an error, not a lost row. Written once, beside the table; the manifest then takes all new partitions at
    once, so that no reader and no crash sees some of them. The partition column stays in the files.
    """
    spark = df.sparkSession
    old = publish.manifest(spark, path)
    parts, rows = publish.stage(df, path, _part(partition))
    publish.publish(spark, path, old, parts=_with(old, parts, emptied), schema=publish.fields(old, df), index=None)
    return rows


def _with(old: dict[str, Any] | None, parts: dict[str, str], emptied: Sequence[str]) -> dict[str, str]:
    return {k: v for k, v in (old["parts"] if old else {}).items() if k not in emptied} | parts


def merge_snapshot(new: DataFrame, path: str, keys: Sequence[str], version: Sequence[str], newest: Newest = keep_latest) -> int:
    """Merge into an unpartitioned dataset: union, newest per key, replace. Returns its rows."""
    spark = new.sparkSession
    existing = publish.read(spark, path) if publish.manifest(spark, path) else None
    return overwrite(merged(existing, new, keys, version, newest), path)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def _semi(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join in which null keys are equal, as they are to the merge."""
    named = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(named, on, how)


def merge_partitioned(new: DataFrame, path: str, keys: Sequence[str], version: Sequence[str], partition: str, keys_move: bool = True,
        newest: Newest = keep_latest, fixed: Mapping[str, str] | None = None) -> tuple[int, list[str]]:
    """Merge that reads and rewrites only touched partitions; returns rows written and the partitions.

    Touched are those that new rows belong to and those that already hold a key that comes in, so that a key that moves leaves no stale
    copy; a partition that this empties is dropped. Where keys are, an index tells that lies beside the table: keys and their partition,
    in buckets by hash of the key. A merge reads the buckets of its own keys and publishes them anew together with the partitions, so
    that the two never differ. A table without an index (written by ``overwrite_partitions``, say) gets one in its first merge. Where a
    key's partition never changes (a day of an event), ``keys_move=False`` goes without. Only lists of partitions and buckets are collected.
    ``fixed`` names columns with one text in all new rows, such as their batch: where no old rows have others, they aren't shuffled.
    """
    spark = new.sparkSession
    old = publish.manifest(spark, path)
    fixed = {} if old else {c: v for c, v in (fixed or {}).items() if c not in (*keys, *version, partition)}
    touched = {r[0] for r in new.select(_part(partition).alias("p")).distinct().collect()}
    held = buckets = index = None
    coming = new.select(*keys).distinct()
    if keys_move:
        index = old["index"] if old else None
        if old and index and index["keys"] == list(keys):
            buckets = {r[0] for r in coming.select(_bucket(keys, index["buckets"])).distinct().collect()}
            schema = T.StructType([*[new.schema[k] for k in keys], T.StructField("_part", T.StringType())])
            held = publish.read_folders(spark, path, [f for b, f in index["folders"].items() if b in buckets], schema)
        else:  # no index yet, or one of other keys
            index = {"buckets": INDEX_BUCKETS, "folders": {}}
            held = publish.read(spark, path).select(*keys, _part(partition).alias("_part")) if old else None
    if held is not None:
        touched |= {r[0] for r in _semi(held, coming, keys, "left_semi").select("_part").distinct().collect()}
    existing = publish.read(spark, path, sorted(touched)) if old else None
    rows = merged(existing, new.drop(*fixed), keys, version, newest)
    parts, n = publish.stage(rows, path, _part(partition), fixed)
    if keys_move:
        written = publish.read_folders(spark, path, parts.values(), rows.schema).select(*keys, _part(partition).alias("_part"))
        entries = written if held is None else _semi(held, coming, keys, "left_anti").unionByName(_semi(written, coming, keys, "left_semi"))
        folders, _ = publish.stage(entries, path, _bucket(keys, index["buckets"]), gathered=False)  # keys alone: a task's rows of all buckets are small
        kept = {b: f for b, f in index["folders"].items() if b not in (buckets or ())}
        index = index | {"keys": list(keys), "folders": kept | folders}
    publish.publish(spark, path, old, parts=_with(old, parts, sorted(touched)), schema=publish.fields(old, rows if old else new), index=index)
    return n, sorted(touched)


def upsert(existing: DataFrame, source: DataFrame, keys: Sequence[str], loaded_at: Column | None = None) -> DataFrame:
    """Table after an upsert on ``keys``, with ``_action``: ``updated``, ``inserted`` or ``kept``.

    Source columns that the table lacks are left out; columns that the source lacks keep their values on update. Keys are unique in
    each. One full outer join. With ``loaded_at``, rows that the source brings get it as ``_loaded_at``; others keep theirs (null if the table has none).
    """
    common = [c for c in existing.columns if c in source.columns]
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in common], F.lit(True).alias("_in_source"))
    t = existing.withColumn("_in_table", F.lit(True))
    on = [t[k] == s[f"_s_{k}"] for k in keys]
    joined = t.join(s, on, "full_outer")
    columns = [F.when(F.col("_in_source"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in common else F.col(c) for c in existing.columns]
    action = F.when(F.col("_in_source") & F.col("_in_table"), "updated").when(F.col("_in_source"), "inserted").otherwise("kept")
    if loaded_at is not None:
        before = F.col("_loaded_at") if "_loaded_at" in existing.columns else F.lit(None).cast("timestamp")
        columns = [c for c, name in zip(columns, existing.columns, strict=True) if name != "_loaded_at"] + [F.when(F.col("_in_source"),
            loaded_at).otherwise(before).alias("_loaded_at")]
    return joined.select(*columns, action.alias("_action"))


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """One row: rows read, inserted and updated."""
    n = lambda a: F.count_if(F.col("_action") == a)
    return upserted.agg((n("inserted") + n("updated")).alias("read"), n("inserted").alias("inserted"), n("updated").alias("updated"))


def skipped_columns(existing: DataFrame, source: DataFrame) -> list[str]:
    return [c for c in source.columns if c not in existing.columns]


def replace_recent(existing: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """Delete the keys that were recomputed and append the new rows; new columns are appended."""
    return union_by_name(existing.join(recomputed.select(key).distinct(), key, "left_anti"), recomputed)


def since_lookback(source: DataFrame, day: str, loaded: DataFrame, loaded_day: str, days: int) -> DataFrame:
    """Source rows from ``days`` before the newest loaded day on; all, if nothing is loaded."""
    newest = loaded.agg(F.max(loaded_day).alias("_newest"))
    return source.crossJoin(F.broadcast(newest)).where(F.col("_newest").isNull() | (F.col(day) >= F.date_sub("_newest", days))).drop("_newest")


def months_from(rows: DataFrame, touched: DataFrame, keys: Sequence[str], month: str) -> DataFrame:
    """(keys, month) of all rows at or after the first touched month of their key.

    What a late row changes: numbers and running sums of its own and of all later months, not only of the touched one.
    """
    first = touched.groupBy(*keys).agg(F.min(month).alias("_first"))
    return rows.join(first, list(keys)).where(F.col(month) >= F.col("_first")).select(month).distinct()


def write_with_stats(df: DataFrame, path: str, table: str, partition: str | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """Write a table, or only its partitions of some months; returns what was written: ``table``, ``partition`` and ``rows``, one row per partition."""
    spark, schema = df.sparkSession, "table string, partition string, rows long"
    if partition is None:
        return spark.createDataFrame([(table, None, overwrite(df, path))], schema)
    overwrite_partitions(df, path, partition, months or ())
    held = publish.read(spark, path, months).groupBy(F.col(partition).cast("string").alias("partition")).agg(F.count(F.lit(1)).alias("rows"))
    return held.select(F.lit(table).alias("table"), "partition", "rows")
