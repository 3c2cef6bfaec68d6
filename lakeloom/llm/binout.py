"""Token-ID output: blocks coded by a static range asymmetric numeral system, and their parallel decoding."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm import tokens as tok
from lakeloom.llm.common import materialize, shared_dir, ship_package, table

#: Bits of the frequency scale; lower bound of a state; lanes of a block; steps between checkpoints; ids of a block; end id.
SCALE, LOW, LANES, EVERY, BLOCK_IDS, END_ID = 20, 1 << 31, 1024, 256, 1 << 20, 0
BLOCK_SCHEMA = ("part int, at bigint, n_docs bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, lanes int, words binary, states binary, "
    "checkpoint_words array<bigint>, checkpoint_states binary, crc32 bigint, stretch_crc32 array<bigint>, every int")
#: Version of the files, which their table names.
FORMAT = 1


def scaled_frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to sum to 2^scale; every symbol that occurs keeps at least 1."""
    total, m = int(counts.sum()), 1 << scale
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * m / max(1, total)), 0).astype(np.int64)
    over = int(freq.sum()) - m
    for s in np.argsort(-freq, kind="stable"):
        if over == 0 or total == 0:
            break
        take = min(over, int(freq[s]) - 1) if over > 0 else over
        freq[s] -= take
        over -= take
    return freq.astype(np.uint64)


class Rans:
    """Interleaved coder: id i of a block goes to lane i mod lanes; all lanes take a step together as arrays."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq, self.scale = freq, np.uint64(scale)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = np.uint64((LOW >> scale) << 32) * freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[int, bytes, bytes, list[int], bytes]:
        """(lanes, words, states, word positions of checkpoints, states at checkpoints)."""
        lanes = max(1, min(LANES, len(ids) // 64))
        steps = -(-len(ids) // lanes)
        x = np.full(lanes, LOW, dtype=np.uint64)
        out: list[np.ndarray] = []
        size, marks = 0, []
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            y, f = x[: len(s)], self.freq[s]
            full = y >= self.limit[s]
            w = y[full].astype(np.uint32)
            y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[: len(s)] = (q << self.scale) + (y - q * f) + self.cum[s]
            out.append(w)
            size += len(w)
            if t and t % EVERY == 0:
                marks.append((size, x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, dtype=np.uint32)
        marks.reverse()
        held = b"".join(m[1].astype("<u8").tobytes() for m in marks)
        return lanes, words.astype("<u4").tobytes(), x.astype("<u8").tobytes(), [size - m[0] for m in marks], held

    def decode(self, n: int, lanes: int, words: bytes, states: bytes, first_step: int = 0, at: int = 0, last_step: int | None = None) -> np.ndarray:
        """Ids of steps ``first_step`` to ``last_step``; with a checkpoint's states and word position, from the middle of a block."""
        stream, x = np.frombuffer(words, dtype="<u4"), np.frombuffer(states, dtype="<u8").astype(np.uint64)
        steps = -(-n // lanes)
        last_step = steps if last_step is None else min(steps, last_step)
        ids = np.empty(max(0, min(n, last_step * lanes) - first_step * lanes), dtype=np.uint32)
        mask, low = np.uint64((1 << int(self.scale)) - 1), np.uint64(LOW)
        for t in range(first_step, last_step):
            k = min(lanes, n - t * lanes)
            y = x[:k]
            slot = y & mask
            s = self.symbol[slot]
            y = self.freq[s] * (y >> self.scale) + slot - self.cum[s]
            short = np.flatnonzero(y < low)
            if at + len(short) > len(stream):
                raise ValueError("a block is damaged: its words end early")
            y[short] = (y[short] << np.uint64(32)) | stream[at : at + len(short)]
            at += len(short)
            x[:k] = y
            ids[(t - first_step) * lanes : (t - first_step) * lanes + k] = s
        return ids


def id_counts(rows: DataFrame, width: str, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all rows: summed per task, then over tasks; the driver sees one number per id."""

    def count(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(x, dtype=width), minlength=vocabulary) if len(x) > vocabulary else 0
                if len(x) <= vocabulary:
                    np.add.at(total, np.frombuffer(x, dtype=width), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(vocabulary, dtype=np.int64)
    for r in rows.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def encode_sorted(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Ids of each document in order of ``doc_id``: ``part`` (range partition), ``at`` (ids before it in its part), ``doc_id``,
    ``n`` and ``ids``. Rows without an id come first; rows that share one follow each other."""

    def encode(batches):
        from pyspark import TaskContext

        enc, part, at = tok.encoder(path), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], dtype=enc.kind).tobytes()
        for batch in tok.sliced(batches):
            ids = [x + end for x in enc.encode(batch.column("text").to_pylist())]
            n = np.asarray([len(x) // enc.kind.itemsize for x in ids], dtype=np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            parts = pa.array(np.full(len(n), part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([parts, pa.array(before, pa.int64()), batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "at", "doc_id", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")  # rows of one id, or without, are spread too
    return materialize(ordered.mapInArrow(encode, "part int, at bigint, doc_id bigint, n bigint, ids binary"), "sorted-ids", "zstd")


def write_blocks(docs: DataFrame, path: str, out: str, end_id: int = END_ID) -> None:
    """Write all documents as coded blocks in order of ``doc_id`` to the new folder ``out``, which any session can decode by itself.

    ``out/table`` has one row: version of the format, scale, the shared frequencies and their crc32. ``out/blocks`` has the blocks. Ids of
    documents are cast to long.

    Two passes over materialized ids: one counts all ids for the frequency table that every block shares, one codes.
    A block holds whole documents of one part, up to about ``BLOCK_IDS`` ids (a longer document has a block of its
    own), and can be decoded by itself: it carries its documents' ids and lengths, the coder's states, checkpoints, and the
    crc32 of its ids and of each stretch between checkpoints. Files are written by Spark's committer, so that lost executors leave no half blocks.
    """
    spark = docs.sparkSession
    ship_package(spark)
    enc = tok.encoder(path)
    kind, vocabulary = enc.kind.str, enc.tokenizer.get_vocab_size()
    rows = encode_sorted(docs, path, end_id)
    freq = scaled_frequencies(id_counts(rows, kind, max(vocabulary, end_id + 1)))
    shared = spark.sparkContext.broadcast(freq)  # one number per id of the vocabulary

    def blocks(batches):
        coder = Rans(shared.value)
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush():
            ids = np.frombuffer(b"".join(h[3] for h in held), dtype=kind)
            lanes, words, states, where, marks = coder.encode(ids)
            lengths = [len(h[3]) // ids.itemsize for h in held]
            ids = ids.astype("<u4")
            stretches = [zlib.crc32(ids[i : i + lanes * EVERY].tobytes()) for i in range(0, max(1, len(ids)), lanes * EVERY)]
            row = [held[0][0], held[0][1], len(held), len(ids), [h[2] for h in held], lengths, lanes, words, states, where, marks, zlib.crc32(ids.tobytes()), stretches, EVERY]
            arrays = [pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, _BLOCK_NAMES)

        for batch in batches:
            for part, at, doc, n, ids in zip(*[batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "n", "ids")], strict=True):
                if held and (part != held[-1][0] or size + n > BLOCK_IDS):
                    yield flush()
                    held, size = [], 0
                held.append((part, at, doc, ids))
                size += n
        if held:
            yield flush()

    table_ = freq.astype("<u4").tobytes()
    head = [(FORMAT, SCALE, len(freq), bytearray(table_), zlib.crc32(table_))]
    coded = rows.select("part", "at", "doc_id", "n", "ids").mapInArrow(blocks, BLOCK_SCHEMA)
    coded.write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    spark.createDataFrame(head, TABLE_SCHEMA).coalesce(1).write.parquet(f"{out}/table")  # last: a folder without it isn't complete


TABLE_SCHEMA = "version int, scale int, symbols int, frequencies binary, crc32 bigint"
_BLOCK_NAMES = [c.strip().split(" ")[0] for c in BLOCK_SCHEMA.split(",")]
_BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(),
    pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32()]


def open_files(spark: SparkSession, out: str) -> tuple[DataFrame, Rans]:
    """(blocks, coder) of a folder that ``write_blocks`` has written; an unknown version or a damaged table is an error."""
    head = spark.read.schema(TABLE_SCHEMA).parquet(f"{out}/table").head()
    if head is None or head["version"] != FORMAT:
        raise ValueError(f"{out}: not files of format {FORMAT}")
    if zlib.crc32(head["frequencies"]) != head["crc32"] or len(head["frequencies"]) != 4 * head["symbols"]:
        raise ValueError(f"{out}: the frequency table is damaged")
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks"), Rans(np.frombuffer(head["frequencies"], dtype="<u4").astype(np.uint64), head["scale"])


def _part_bases(files: DataFrame) -> DataFrame:
    """``part`` and ``base``, the ids of earlier parts: one row per range partition of the writer."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("base"))


def read_blocks(spark: SparkSession, out: str) -> DataFrame:
    """Decode the blocks of a folder in parallel: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (binary, little-endian
    unsigned 32-bit). A block whose decoded ids don't match its checksum is an error.

    Starts come from the blocks' own headers: ids of earlier parts (one row per part) and of earlier blocks.
    """
    ship_package(spark)
    files, coder = open_files(spark, out)
    shared = spark.sparkContext.broadcast((coder.freq, int(coder.scale)))  # one number per id of the vocabulary

    def decode(batches):
        coder = Rans(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["n_ids"], row["lanes"], row["words"], row["states"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc32"]:
                    raise ValueError(f"block at {row['part']}:{row['at']} is damaged")
                n = np.asarray(row["doc_lengths"], dtype=np.int64)
                before = np.cumsum(n) - n
                parts = [ids[b : b + k].tobytes() for b, k in zip(before.tolist(), n.tolist(), strict=True)]
                out = [pa.array(np.full(len(n), row["part"], dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(before + row["at"]),
                    pa.array(n), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["part", "doc_id", "at", "n_tokens", "ids"])

    base = _part_bases(files)
    docs = files.mapInArrow(decode, "part int, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")  # one row per part


def read_range(spark: SparkSession, out: str, first: int, last: int) -> DataFrame:
    """Ids ``first`` to below ``last`` of the whole output, as pieces ``start`` and ``ids``: only what a piece needs is decoded.

    Every stretch between two checkpoints of a block is decoded by itself, from the checkpoint's states and word position, so that
    one block (a very long document, say) is spread over tasks, and none before or behind the range is decoded. A stretch whose ids
    don't match its checksum is an error.
    """
    ship_package(spark)
    files, coder = open_files(spark, out)
    shared = spark.sparkContext.broadcast((coder.freq, int(coder.scale)))

    def decode(batches):
        coder = Rans(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                k, lanes = row["stretch"], row["lanes"]
                states = row["states"] if k == 0 else row["checkpoint_states"][8 * lanes * (k - 1) : 8 * lanes * k]
                at = row["checkpoint_words"][k - 1] if k else 0
                every = row["every"]
                ids = coder.decode(row["n_ids"], lanes, row["words"], states, k * every, at, (k + 1) * every).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["stretch_crc32"][k]:
                    raise ValueError(f"ids from {row['begin']} are damaged")
                lo, hi = max(first, row["begin"]), min(last, row["begin"] + len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([ids[lo - row["begin"] : hi - row["begin"]].tobytes()], pa.binary())], ["start", "ids"])

    at = files.join(F.broadcast(_part_bases(files)), "part").withColumn("begin", F.col("base") + F.col("at"))  # one row per part
    met = at.where((F.col("begin") < last) & (F.col("begin") + F.col("n_ids") > first))
    each = met.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.size("checkpoint_words"))))
    stretch = F.col("lanes").cast("long") * F.col("every")
    begin = F.col("begin") + F.col("stretch") * stretch
    length = F.least(stretch, F.col("n_ids") - F.col("stretch") * stretch)
    each = each.withColumn("begin", begin).where((F.col("begin") < last) & (F.col("begin") + length > first))
    columns = ["begin", "stretch", "n_ids", "lanes", "words", "states", "checkpoint_words", "checkpoint_states", "stretch_crc32", "every"]
    return each.select(*columns).mapInArrow(decode, "start bigint, ids binary")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write the files, read them back, and sum up each document."""
    out = f"{shared_dir(spark)}/id-files-{uuid.uuid4().hex}"
    write_blocks(table(spark, sf_dir, "documents"), tok.public_path("byte_bpe_50k.json"), out)
    return read_blocks(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
