"""Packing of documents into fixed windows: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm import tokens as tok
from lakeloom.llm.common import distributed_rank, materialize, running_total, ship_package, table

#: Ids of a sequence; width of a length class; most documents of one combination; id that ends a document.
WINDOW, UNIT, DEPTH, END_ID = 4096, 16, 3, 2


def tokenize(docs: DataFrame, path: str, end_id: int, columns: list[str] | None = None) -> DataFrame:
    """``_row`` (a number of its own for each row), the given columns, ``n`` ids and ``ids`` (binary, little-endian unsigned).

    Whole texts, with ``end_id`` behind; a null or empty text is only that id. Materialized, since ids are needed
    again: a text is encoded once. Bounded memory: a task holds one Arrow batch and a bounded cache of pieces.
    """
    columns = columns or ["doc_id"]
    ship_package(docs.sparkSession)

    def encode(batches):
        enc = tok.encoder(path)
        end = np.asarray([end_id], dtype=enc.kind).tobytes()
        for batch in tok.sliced(batches):
            ids = [x + end for x in enc.encode(batch.column("text").to_pylist())]
            n = pa.array([len(x) // enc.kind.itemsize for x in ids], pa.int64())
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *kept, n, pa.array(ids, pa.binary())], ["_row", *columns, "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *columns, F.coalesce("text", F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["_row bigint", *[f"`{c}` {kinds[c]}" for c in columns], "n bigint", "ids binary"])
    return materialize(rows.mapInArrow(encode, schema), "tokens", "zstd")


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` length classes that fill the window exactly."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < depth:
            room = depth - len(head)
            for b in range(min(left, most), max(0, -(-left // room) - 1), -1):
                grow((*head, b), left - b, b)

    grow((), bins, bins)
    return found


def solve_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], steps: int = 600) -> np.ndarray:
    """Whole repeat counts of the combinations: min ||A x - h||, x >= 0 by accelerated projected gradient, then rounded down
    and cut back where a class would be used more often than it has documents. A has a column for each combination."""
    bins = len(histogram)
    idx = np.concatenate([np.asarray(c) - 1 for c in combos])
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    h = histogram.astype(float)
    apply = lambda x: np.bincount(idx, weights=x[col], minlength=bins)
    back = lambda r: np.bincount(col, weights=r[idx], minlength=len(combos))
    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / max(1e-9, 1.02 * np.linalg.norm(back(apply(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0.0, y - rate * back(apply(y) - h))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    counts = np.floor(x + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for s in np.argsort(-x, kind="stable"):
        need = np.bincount(np.asarray(combos[s]) - 1, minlength=bins)
        counts[s] = max(0, min(counts[s], *(left[b] // need[b] for b in np.flatnonzero(need))))
        left -= counts[s] * need
    return counts


def plan_pieces(lengths: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """Pieces ``_row``, ``start``, ``length``, ``sequence_id``, ``offset`` for documents (``_row``, ``n`` > 0).

    Documents of a window and more give full windows of their own. What remains of each falls into a length class
    of ``unit``; the histogram of classes (at most window / unit numbers) is all that the driver sees. It solves how
    often each combination of up to ``depth`` classes is used, and the places of the combinations go to the documents
    of each class by their rank in it, which is computed in distributed form, as one class may hold a third of all.
    Documents beyond the solved places are packed greedily: end to end, largest class first, cut at window boundaries.
    """
    spark = lengths.sparkSession
    bins = window // unit
    lengths = lengths.withColumn("full", F.floor(F.col("n") / window).cast("long")).withColumn("left", F.col("n") % window)
    rest = lengths.where("left > 0").select("_row", (F.col("n") - F.col("left")).alias("start"), F.col("left").alias("length"),
        F.ceil(F.col("left") / unit).cast("int").alias("bin"))
    ranked = materialize(distributed_rank(rest, ["bin"], ["_row"], "pack-rank"), "pack-ranked")
    histogram = np.zeros(bins, dtype=np.int64)
    for r in ranked.groupBy("bin").count().collect():  # at most window / unit rows
        histogram[r["bin"] - 1] = r["count"]
    combos = combinations(bins, depth)
    counts = solve_counts(histogram, combos)
    used, places, sequences = [0] * (bins + 1), [], 0
    for s in np.flatnonzero(counts):
        for slot, b in enumerate(combos[s]):
            places.append((int(b), used[b], used[b] + int(counts[s]), sequences, slot))
            used[b] += int(counts[s])
        sequences += int(counts[s])
    solved = spark.createDataFrame(places, "bin int, lo long, hi long, base long, slot int")  # bounded by the combinations
    fits = (ranked["bin"] == solved["bin"]) & (ranked["rank"] >= solved["lo"]) & (ranked["rank"] < solved["hi"])
    placed = ranked.join(F.broadcast(solved), fits).select("_row", "start", "length", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "slot")
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("long")).drop("slot")
    quota = F.get(F.array(*[F.lit(u).cast("long") for u in used]), F.col("bin"))
    over = ranked.where(F.col("rank") >= quota).withColumn("_down", -F.col("bin"))
    stream = running_total(over, ["_down", "rank"], "length", "pack-rest", "at")
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window)
    cut = stream.withColumn("w", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest(F.col("at"), F.col("w") * window), F.least(F.col("at") + F.col("length"), (F.col("w") + 1) * window)
    # even numbers go to combinations and the stream, odd ones to full windows: no count of one is needed for the other
    streamed = cut.select("_row", (F.col("start") + lo - F.col("at")).alias("start"), (hi - lo).alias("length"), (F.col("w")
        + sequences).alias("sequence_id"), (lo - F.col("w") * window).alias("offset"))
    whole = running_total(lengths.where("full > 0").select("_row", "full"), ["_row"], "full", "pack-full", "before")
    whole = whole.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    windows = whole.select("_row", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), (2 * (F.col("before")
        + F.col("k")) + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shared = placed.unionByName(streamed).withColumn("sequence_id", 2 * F.col("sequence_id"))
    return shared.unionByName(windows)


def pack(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids`` (binary).

    Ids are encoded once and meet their pieces in one shuffle. Every row of ``docs`` is a document of its own, also where
    ids repeat; null texts count as empty. Each id lies in exactly one piece; offsets have no gaps from 0.
    """
    rows = tokenize(docs, path, end_id)
    pieces = plan_pieces(rows.select("_row", "n"), window, unit, depth)
    width = tok.encoder(path).kind.itemsize
    met = rows.join(pieces, "_row")
    part = F.substring(F.col("ids"), (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    return met.select("doc_id", "start", "length", F.col("n").alias("doc_tokens"), "sequence_id", "offset", part.alias("ids"))


def with_crc(pieces: DataFrame, path: str) -> DataFrame:
    """``pieces`` with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) in place of ``ids``."""
    columns = [c for c in pieces.columns if c != "ids"]
    kind = tok.encoder(path).kind

    def check(batches):
        for batch in batches:
            crc = [tok.crc_of_ids(np.frombuffer(x, dtype=kind)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(crc, pa.int64())], [*columns, "ids_crc32"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    return pieces.mapInArrow(check, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "ids_crc32 bigint"]))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the pieces of all documents with checksums of their ids."""
    path = tok.public_path("word_bpe_49k.json")
    out = with_crc(pack(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
