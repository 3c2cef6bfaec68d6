"""Tables in versions: data lies in folders that never change, and one small manifest says which of them are the table.

A write puts its rows beside the table, then a new manifest takes its place by one rename. Readers follow the newest manifest, so they see
the whole old table or the whole new one, wherever a writer stops; what a manifest of the last two versions names is never deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions whose data is kept, so that a reader of the last but one can finish.
KEPT = 2
#: How files of a table are packed.
CODEC = "zstd"


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of a path in any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, p = _hadoop(spark, f"{path}/_manifests")
    names = [s.getPath().getName() for s in files.listStatus(p)] if files.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def _load(spark: SparkSession, path: str, version: int) -> dict[str, Any]:
    files, p = _hadoop(spark, f"{path}/_manifests/{version:012d}")
    stream = files.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The newest manifest: ``version``, ``schema``, ``parts`` (folder of each partition value; one, ``""``, if there is no partition), ``index``."""
    versions = _versions(spark, path.rstrip("/"))
    return _load(spark, path.rstrip("/"), versions[-1]) if versions else None


def read_folders(spark: SparkSession, path: str, folders: Iterable[str], schema: T.StructType) -> DataFrame:
    """Rows of some folders of a table; columns that files lack are null. No footer is read beforehand."""
    paths = [f"{path.rstrip('/')}/{f}" for f in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, parts: Iterable[str] | None = None) -> DataFrame:
    """The table as its newest manifest has it, or only some of its partitions; no other folder is listed or read."""
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no table at {path}")
    wanted = found["parts"] if parts is None else [p for p in dict.fromkeys(parts) if p in found["parts"]]
    return read_folders(spark, path, [found["parts"][p] for p in wanted], T.StructType.fromJson(found["schema"]))


def stage(df: DataFrame, path: str, by: Column | None = None, fixed: Mapping[str, str] | None = None, gathered: bool = True) -> tuple[dict[str, str], int]:
    """Write ``df`` into new folders beside the table: (folder of each value of ``by``, rows). Rows of one value lie together, large values in several files;
    if they aren't ``gathered``, each task writes its own. ``fixed`` are columns of one text, added behind the shuffle."""
    spark, seen, folder = df.sparkSession, Observation(), f"data/{uuid.uuid4().hex}"
    root = path.rstrip("/")
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if by is None:
        counted.write.option("compression", CODEC).parquet(f"{root}/{folder}")
        return {"": folder}, seen.get["n"]
    name = "part"
    while name in df.columns:
        name += "_"
    rows = counted.withColumn(name, by)
    rows = (rows.hint("rebalance", name) if gathered else rows).withColumns({c: F.lit(v) for c, v in (fixed or {}).items()})
    rows.write.option("compression", CODEC).partitionBy(name).parquet(f"{root}/{folder}")
    files, p = _hadoop(spark, f"{root}/{folder}")
    names = [s.getPath().getName() for s in files.listStatus(p) if s.isDirectory()]
    value = lambda n: "" if n == f"{name}=__HIVE_DEFAULT_PARTITION__" else unquote(n.removeprefix(f"{name}="))
    return {value(n): f"{folder}/{n}" for n in names}, seen.get["n"]


def _write_small(spark: SparkSession, path: str, text: str) -> None:
    files, p = _hadoop(spark, path)
    out = files.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _rename(spark: SparkSession, source: str, target: str) -> None:
    files, p = _hadoop(spark, source)
    if files.exists(_hadoop(spark, target)[1]) or not files.rename(p, _hadoop(spark, target)[1]):
        raise OSError(f"cannot publish {target}: another writer has, or the store refuses")


def _delete(spark: SparkSession, path: str) -> None:
    files, p = _hadoop(spark, path)
    files.delete(p, True)


def publish(spark: SparkSession, path: str, old: dict[str, Any] | None, **changes: Any) -> None:
    """Make a new version, the ``old`` manifest with ``changes``, the one that readers see. A version that another writer has published first is an error."""
    root = path.rstrip("/")
    new = {"parts": {}, "index": None} | (old or {}) | changes | {"version": (old["version"] if old else 0) + 1}
    draft = f"{root}/_manifests/_draft-{uuid.uuid4().hex}"
    _write_small(spark, draft, json.dumps(new))
    _rename(spark, draft, f"{root}/_manifests/{new['version']:012d}")
    _clean(spark, root)


def _named(found: dict[str, Any]) -> set[str]:
    return {*found["parts"].values(), *((found["index"] or {}).get("folders", {}).values())}


def _clean(spark: SparkSession, root: str) -> None:
    """Drop manifests before the last ``KEPT``, and the folders that only they name."""
    versions = _versions(spark, root)
    kept = set().union(*(_named(_load(spark, root, v)) for v in versions[-KEPT:]))
    for v in versions[:-KEPT]:
        for folder in sorted(_named(_load(spark, root, v)) - kept):
            _delete(spark, f"{root}/{folder}")
        _delete(spark, f"{root}/_manifests/{v:012d}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Drop folders that no kept manifest names, left by writers that stopped; returns how many. No writer may be at work."""
    root, dropped = path.rstrip("/"), 0
    kept = set().union(*(_named(_load(spark, root, v)) for v in _versions(spark, root)[-KEPT:]))
    files, p = _hadoop(spark, f"{root}/data")
    for status in files.listStatus(p) if files.exists(p) else []:
        name = f"data/{status.getPath().getName()}"
        parts = [f"{name}/{s.getPath().getName()}" for s in files.listStatus(status.getPath()) if s.isDirectory()]
        unused = [x for x in parts if x not in kept] if any(x in kept for x in parts) else [] if name in kept else [name]
        for x in unused:
            _delete(spark, f"{root}/{x}")
        dropped += len(unused)
    return dropped


def fields(old: dict[str, Any] | None, df: DataFrame) -> dict[str, Any]:
    """Schema of a table that ``df`` has been added to: its columns, then those that only ``df`` has."""
    have = T.StructType.fromJson(old["schema"]).fields if old else []
    names = {f.name for f in have}
    return json.loads(T.StructType([*have, *[f for f in df.schema.fields if f.name not in names]]).json())
