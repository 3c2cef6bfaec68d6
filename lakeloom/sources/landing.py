"""Landing: lineage columns, a ledger of contents, drift against a contract, watermarks and run telemetry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """Columns that a dataset must and may have, its key, and what orders versions of a key."""

    dataset: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    version: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return self.required + self.optional


class BreakingDrift(ValueError):
    """A delivery lacks required columns."""


def drift(spark: SparkSession, contract: Contract, delivered: Sequence[str]) -> DataFrame:
    """``dataset``, ``column``, ``change`` and ``severity``: missing required is ERROR, missing optional WARN, new INFO."""
    own = {c for c in delivered if not c.startswith("_")}
    events = [(contract.dataset, c, "missing_required", "ERROR") for c in contract.required if c not in own]
    events += [(contract.dataset, c, "missing_optional", "WARN") for c in contract.optional if c not in own]
    events += [(contract.dataset, c, "new_column", "INFO") for c in sorted(own - set(contract.columns))]
    return spark.createDataFrame(events, "dataset string, column string, change string, severity string")


def drift_gate(events: DataFrame) -> DataFrame:
    """One row: events by severity, new columns, and whether a batch may go on."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return events.agg(n("ERROR").alias("errors"), n("WARN").alias("warnings"), n("INFO").alias("infos"),
        F.array_sort(F.collect_set(F.when(F.col("change") == "new_column", F.concat_ws(".", "dataset", "column")))).alias("new_columns"),
        (n("ERROR") == 0).alias("passed"))


def raise_on_breaking(events: DataFrame) -> None:
    missing = [r["column"] for r in events.where("severity = 'ERROR'").collect()]
    if missing:
        raise BreakingDrift(f"missing required columns: {', '.join(sorted(missing))}")


def with_lineage(rows: DataFrame, batch_id: str, source_file: str | None, run_id: str) -> DataFrame:
    """``rows`` with ``_batch_id``, ``_source_file``, ``_ingested_at``, ``_run_id`` and ``_row_number`` (kept where a reader gave it)."""
    have = set(rows.columns)
    number = F.col("_row_number") if "_row_number" in have else F.monotonically_increasing_id() + 1
    source = F.col("_source_file") if source_file is None and "_source_file" in have else F.lit(source_file)
    return rows.withColumns({"_batch_id": F.lit(batch_id), "_source_file": source, "_ingested_at": F.current_timestamp(), "_run_id": F.lit(run_id),
        "_row_number": number.cast("long")})


def land(rows: DataFrame, contract: Contract, path: str, batch_id: str, source_file: str | None, run_id: str) -> DataFrame:
    """Write a delivery as its batch's partition (landing it again replaces it); returns the drift events. Breaking drift raises first."""
    events = drift(rows.sparkSession, contract, rows.columns)
    raise_on_breaking(events)
    landed = with_lineage(rows, batch_id, source_file, run_id)
    landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(path)
    return events


#: Modulus and bases of the polynomials that stand for a sequence of lines; products of two residues fit a long.
_PRIME, _BASES = (1 << 31) - 1, (741_103_597, 1_206_291_356, 336_513_281, 1_833_091_741)


def _power(base: int, exponent: Column) -> Column:
    """``base ** exponent`` modulo ``_PRIME``, for exponents from 0 to 2^40: one table of 256 powers for each byte of the exponent."""
    out = None
    for byte in range(5):
        step = pow(base, 1 << (8 * byte), _PRIME)
        powers = [1]
        for _ in range(255):
            powers.append(powers[-1] * step % _PRIME)
        one = F.get(F.from_json(F.lit(str(powers)), "array<bigint>"), F.shiftright(exponent, 8 * byte).bitwiseAND(F.lit(255)).cast("int"))
        out = one if out is None else F.pmod(out * one, F.lit(_PRIME))
    return out


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``source_file``, ``content_hash`` and ``bytes`` of every text file: equal only for files with the same lines in the same order.

    Files are read in splits, line by line, so that none is held as a whole and no line is shuffled. A sequence of lines stands for the
    polynomial whose coefficients are the lines' hashes, at four points of a field of 31 bits each. Such values can be joined: those of a split
    are sums over its lines, and a file's are the sums over its splits, each moved up by the lines before it. So they see the order of
    lines, and don't depend on how the session cuts files. The number of bytes tells whether the last line ends with a line feed.
    Two given files that differ get one hash with a chance of about 2^-124.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    hashes = [F.xxhash64("value"), F.xxhash64(F.lit(7), "value")]
    halves = [F.pmod(x, F.lit(_PRIME)) for h in hashes for x in (h, F.shiftrightunsigned(h, 31))]
    # ids count on within a partition: the place in the split is the id less the split's first one, for which the sum is divided by a power afterwards
    place = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    terms = [F.sum(F.pmod(h * _power(b, place), F.lit(_PRIME))).alias(f"h{k}") for k, (h, b) in enumerate(zip(halves, _BASES, strict=True))]
    splits = lines.groupBy("source_file", "at").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), *terms)
    earlier = Window.partitionBy("source_file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    moved = []
    for k, b in enumerate(_BASES):
        back = F.pmod(F.pmod(F.col(f"h{k}"), F.lit(_PRIME)) * _power(pow(b, -1, _PRIME), F.col("first")), F.lit(_PRIME))
        moved.append(F.pmod(F.sum(F.pmod(back * _power(b, F.col("before")), F.lit(_PRIME))), F.lit(_PRIME)).alias(f"h{k}"))
    files = splits.groupBy("source_file").agg(F.max("bytes").alias("bytes"), F.sum("n").alias("n"), *moved)
    return files.select("source_file", F.sha2(F.concat_ws("|", "bytes", "n", *[f"h{k}" for k in range(len(_BASES))]), 256).alias("content_hash"), "bytes")


LEDGER = "dataset string, content_hash string, source_file string, status string, rows bigint, rejected bigint, run_id string"


def not_yet_landed(files: DataFrame, ledger: DataFrame, dataset: str, force: bool = False) -> DataFrame:
    """Files whose content the ledger doesn't hold as a success of this dataset; of equal contents the first by name. ``force`` gives all."""
    first = files.groupBy("content_hash").agg(F.min("source_file").alias("source_file"))
    done = ledger.where((F.col("dataset") == dataset) & (F.col("status") == "success")).select("content_hash").distinct()
    return first if force else first.join(done, "content_hash", "left_anti")


def ledger_entries(files: DataFrame, dataset: str, rows: int | Column, rejected: int | Column, run_id: str, status: str = "success") -> DataFrame:
    """Ledger rows of ``files``; ``rows`` and ``rejected`` are one number for all, or columns of ``files``."""
    rows, rejected = (x if isinstance(x, Column) else F.lit(x) for x in (rows, rejected))
    return files.select(F.lit(dataset).alias("dataset"), "content_hash", "source_file", F.lit(status).alias("status"),
        rows.cast("bigint").alias("rows"), rejected.cast("bigint").alias("rejected"), F.lit(run_id).alias("run_id"))


def watermark(rows: DataFrame, dataset: str, batch_id: str, column: str) -> DataFrame:
    """High-water mark of a dataset: its last batch and newest business time."""
    return rows.agg(F.lit(dataset).alias("dataset"), F.lit(batch_id).alias("last_batch_id"), F.max(column).alias("high_watermark"))


def advance(marks: DataFrame, new: DataFrame) -> DataFrame:
    """Stored marks after new ones: the later batch and the later time of each dataset, so that a rerun of an old batch moves nothing back."""
    both = marks.unionByName(new)
    return both.groupBy("dataset").agg(F.max("last_batch_id").alias("last_batch_id"), F.max("high_watermark").alias("high_watermark"))


def run_mode(marks: DataFrame, dataset: str, batch_id: str) -> str:
    """``initial`` without a mark, ``rerun`` if the last batch isn't older, else ``incremental``."""
    last = marks.where(F.col("dataset") == dataset).agg(F.max("last_batch_id")).head()[0]
    return "initial" if last is None else "rerun" if last >= batch_id else "incremental"


def land_documents(documents: DataFrame, contract: Contract, path: str, batch_id: str, as_of: str | None, run_id: str, ledger: DataFrame) -> DataFrame:
    """Land reference rows that came as JSON documents (``source_file``, ``value``): from response to landed table.

    Documents whose content the ledger holds are left out; the others' array ``data`` becomes text columns, dated by ``as_of`` where the
    contract has ``rate_date`` and a row lacks it. Elements that are no objects, and documents without the array (one each), are rejects.
    Returns the ledger's new entries, with the rows and rejects of each document.
    """
    hashed = documents.withColumn("content_hash", F.sha2("value", 256))
    fresh = not_yet_landed(hashed, ledger, contract.dataset)
    items = F.from_json(F.get_json_object("value", "$.data"), "array<string>")
    parsed = hashed.join(fresh.select("source_file"), "source_file", "left_semi").withColumn("items", items)
    objects = F.filter("items", lambda x: F.coalesce(F.trim(x).startswith("{"), F.lit(False)))
    rows = parsed.select(F.col("source_file").alias("_source_file"), F.explode(F.transform(objects, lambda x: F.from_json(x, "map<string,string>"))).alias("_m"))
    text = {c: F.try_element_at("_m", F.lit(c)) for c in contract.columns}
    if as_of is not None and "rate_date" in text:
        text["rate_date"] = F.coalesce(text["rate_date"], F.lit(as_of))
    land(rows.select("_source_file", *[v.alias(c) for c, v in text.items()]), contract, path, batch_id, None, run_id)
    good = F.coalesce(F.size(objects), F.lit(0))
    counted = parsed.select("source_file", "content_hash", good.alias("n"), F.when(F.col("items").isNull(), 1).otherwise(F.size("items") - good).alias("bad"))
    return ledger_entries(counted, contract.dataset, F.col("n"), F.col("bad"), run_id)


def append_telemetry(rows: DataFrame, path: str, run_id: str) -> None:
    """Append rule statistics, drift events or batch counts of a run."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
