"""Log-bilinear language model over word classes, trained with noise-contrastive estimation in numpy, one shard of the documents a task."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize, ship_package, table

#: Classes of words without one of their own, by their last two bytes; most frequent words that are classes of their own.
SHARED, OWN = 128, 128
#: Most frequent words whose counts every task holds; a key takes at most 66 bytes. All other counts are met by a join.
TOP = 1 << 17
#: Dimensions of a vector, words of context; tokens of a training step, noise samples of a step, step size.
DIMS, CONTEXT, STEP, NOISE, RATE = 16, 3, 2048, 32, 0.15
#: Tasks that train at a time; different words that a task counts before it hands them on; tokens that are scored together.
TRAINERS, COUNTED, SCORED = 4096, 1 << 19, 1 << 9
#: Words of more bytes are counted under their digest. Key of the end of a text: no word is empty.
LONG_WORD, END = 64, b""


def keys(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, and the end; ``bytes.split`` parts at ASCII white space only."""
    found = (text or "").encode().lower().split()
    if found and max(map(len, found)) > LONG_WORD:
        found = [w if len(w) <= LONG_WORD else b" " + hashlib.sha256(w).hexdigest().encode() for w in found]
    found.append(END)
    return found


def shared_class(key: bytes) -> int:
    """Class of a word that has none of its own."""
    return zlib.crc32(key[-2:]) % SHARED


def shared_class_of(key: Column) -> Column:
    """``shared_class`` as a column."""
    return F.pmod(F.crc32(F.substring(key, -2, 2)), F.lit(SHARED)).cast("int")


class Words(dict):
    """Numbers of the most frequent words by key; other words get ``-1 - class``."""

    def __missing__(self, key: bytes) -> int:
        return -1 - shared_class(key)


class Model:
    """Score of class w after context h: ``q[w] . (sum of c[i] * r[h[i]]) + b[w]``; class ``start`` stands for places before the text."""

    def __init__(self, share: np.ndarray, seed: int = 13):
        rnd = np.random.default_rng(seed)
        n = len(share)
        self.start, self.share = n, share
        self.r = rnd.normal(0, 0.1, (n + 1, DIMS)).astype(np.float32)
        self.q = rnd.normal(0, 0.1, (n, DIMS)).astype(np.float32)
        self.c = np.full((CONTEXT, DIMS), 0.5, dtype=np.float32)
        self.b = np.log(share).astype(np.float32)[:, None]
        self.seen = [np.full(x.shape, 1.0, dtype=np.float32) for x in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c, self.b]

    def flat(self) -> np.ndarray:
        """Parameters, and the squares of their gradients so far, as one row of values."""
        return np.concatenate([x.ravel() for x in self.parts() + self.seen])

    def put(self, values: np.ndarray) -> None:
        """Take everything from one row of values, as ``flat`` gives them."""
        at = 0
        for x in self.parts() + self.seen:
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size

    def contexts(self, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The classes one, two, ... places before each token of texts that lie one after the other."""
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = []
        for i in range(1, CONTEXT + 1):
            before = np.full(len(ids), self.start, dtype=ids.dtype)
            before[i:] = ids[: len(ids) - i] if i <= len(ids) else before[i:]
            before[place < i] = self.start
            out.append(before)
        return out

    def log_probabilities(self, ids: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of each token's probability, normalised over all classes: one matrix product for each ``SCORED`` tokens."""
        out = np.empty(len(ids))
        q = np.concatenate([self.q, self.b], axis=1).T.copy()
        at = [np.concatenate([self.r * c, np.full((len(self.r), 1), 1.0 / CONTEXT, dtype=np.float32)], axis=1) for c in self.c]
        reach = sum(np.sqrt(np.square(x).sum(axis=1)).max() for x in at) * np.sqrt(np.square(q).sum(axis=0)).max()
        for lo in range(0, len(ids), SCORED):
            w = ids[lo : lo + SCORED]
            h = at[0][contexts[0][lo : lo + SCORED]]
            for table_, context in zip(at[1:], contexts[1:], strict=True):
                h += table_[context[lo : lo + SCORED]]
            s = h @ q
            own, top = s[np.arange(len(w)), w].astype(np.float64), 0.0
            if reach > 60:  # else no exponential can pass a float
                top = s.max(axis=1)
                s -= top[:, None]
            np.exp(s, out=s)
            out[lo : lo + SCORED] = own - top - np.log(s.sum(axis=1).astype(np.float64))
        return out


class Trainer:
    """Adagrad on noise-contrastive estimation: each token against ``NOISE`` classes drawn from their shares, common to a step."""

    def __init__(self, model: Model, seed: list[int]):
        self.model, self.rnd = model, np.random.default_rng(seed)
        self.cumulated = np.cumsum(model.share)
        self.log_noise = (np.log(NOISE) + np.log(model.share)).astype(np.float32)

    def step(self, ids: np.ndarray, contexts: list[np.ndarray]) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.cumulated, self.rnd.random(NOISE) * self.cumulated[-1]), len(m.q) - 1)
        before = [m.r[x] for x in contexts]
        h = sum(x * c for x, c in zip(before, m.c, strict=True))
        q, qn, bias = m.q[ids], m.q[noise], m.b[:, 0] - self.log_noise
        up = -_sigmoid(-bias[ids] - np.einsum("ij,ij->i", h, q))
        down = _sigmoid(h @ qn.T + bias[noise])
        dh = up[:, None] * q + down @ qn
        rows, targets = _summed(np.concatenate([ids, noise]), np.concatenate([up[:, None] * h, down.T @ h]))
        biases = np.bincount(ids, weights=up, minlength=len(m.q)) + np.bincount(noise, weights=down.sum(axis=0), minlength=len(m.q))
        words, vectors = _summed(np.concatenate(contexts), np.concatenate([dh * c for c in m.c]))
        self._move(2, slice(None), np.stack([np.einsum("ij,ij->j", dh, x) for x in before]))
        self._move(0, words, vectors)
        self._move(1, rows, targets)
        self._move(3, slice(None), biases[:, None].astype(np.float32))

    def _move(self, part: int, rows, gradient: np.ndarray) -> None:
        seen = self.model.seen[part]
        seen[rows] += gradient * gradient
        self.model.parts()[part][rows] -= RATE * gradient / np.sqrt(seen[rows])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the sums of their values."""
    order = np.argsort(rows.astype(np.int16), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def _count(batches):
    """Words of the texts with their numbers, handed on whenever ``COUNTED`` different ones are held."""
    held: Counter = Counter()

    def out():
        got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return got

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(keys(text))
            if len(held) >= COUNTED:
                yield out()
    yield out()


def _encode(batches, known):
    """Class ids of the words of each text, what words with known counts add to both scores, and the words whose counts are not held."""
    known = known.value
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            k = keys(text)
            at = np.fromiter(map(known["words"].__getitem__, k), dtype=np.int64, count=len(k))
            held = at[at >= 0]
            rare = Counter(k[i] for i in np.flatnonzero(at < 0).tolist())
            ids = np.where(at >= 0, known["class"][np.maximum(at, 0)], -1 - at).astype(np.int16)
            out.append((len(k), len(held), known["base"][held].sum(), known["inside"][held].sum(), ids.tobytes(), list(rare.items())))
        n, known_n, base, inside, ids, rare = zip(*out, strict=True) if out else ([],) * 6
        cols = [pa.array(n, pa.int64()), pa.array(known_n, pa.int64()), pa.array(base, pa.float64()), pa.array(inside, pa.float64()), pa.array(ids, pa.binary())]
        sizes = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]), pa.int32())
        words, times = zip(*chain.from_iterable(rare), strict=True) if any(rare) else ([], [])
        pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "round")), *cols, pa.ListArray.from_arrays(sizes, pairs)],
            ["row", "doc_id", "held_out", "round", "n_tokens", "n_known", "base_score", "inside", "ids", "rare"])


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Class ids of all texts of a batch, one after the other, and their numbers."""
    each = [np.frombuffer(x, dtype=np.int16) for x in batch.column("ids").to_pylist()]
    return np.concatenate(each) if each else np.zeros(0, np.int16), np.array([len(x) for x in each], dtype=np.int64)


def _train(batches, model, round_: int):
    """One row: the tokens that this task has learned from, and its parameters."""
    from pyspark import TaskContext

    trainer, tokens = None, 0
    for batch in batches:
        ids, lengths = _ids(batch)
        if trainer is None and len(ids):
            m = Model(model.value["share"])
            m.put(model.value["flat"])
            trainer = Trainer(m, [round_, TaskContext.get().partitionId()])
        contexts = m.contexts(ids, lengths) if len(ids) else []
        for lo in range(0, len(ids), STEP):
            trainer.step(ids[lo : lo + STEP], [c[lo : lo + STEP] for c in contexts])
        tokens += len(ids)
    if trainer is not None:
        flat = m.flat().astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], ["tokens", "flat"])


def _score(batches, model):
    m = Model(model.value["share"])
    m.put(model.value["flat"])
    for batch in batches:
        ids, lengths = _ids(batch)
        p = m.log_probabilities(ids, m.contexts(ids, lengths)) / np.log(10)
        score = np.add.reduceat(p, np.cumsum(lengths) - lengths) if len(p) else p
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score")),
            pa.array(score + batch.column("inside").to_numpy())], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _averaged(trained: DataFrame) -> np.ndarray | None:
    """Mean of the tasks' parameters, weighted by tokens: added up by place, so that no task and not the driver holds more than two models."""
    each = trained.select("tokens", F.posexplode("flat").alias("place", "x"))
    rows = each.groupBy("place").agg((F.sum(F.col("x") * F.col("tokens")) / F.sum("tokens")).alias("x")).orderBy("place").collect()
    return np.array([r["x"] for r in rows]) if rows else None


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``TOP`` words, by falling number: those above the least step (an eighth of a power of two) that is no longer too many."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    total, least = 0, None
    for s, words in sizes:
        total += words
        if total > TOP:
            break
        least = s
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 1) -> DataFrame:
    """Base and model scores of all texts: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Texts whose ``crc32(id) mod fold`` is not ``held`` are learned from, among them those without an id. A null or empty text is its end
    alone. Repeated rows are texts like others. With nothing to learn from, all classes are equally probable. Other columns of ``docs`` are
    not looked at.

    A token is a class and a word in it. The ``OWN`` most frequent words are classes of their own; each other word belongs to one of
    ``SHARED`` classes by its last two bytes and has there the probability (c + 0.5) / (N + 0.5 (V + 1)), with the class's own N and V. The classes
    follow the log-bilinear model, normalised over all of them, so that all words, unseen ones included, have probabilities that add up.

    Every training text is learned from once, in ``fold - 1`` rounds by its remainder: each task goes over its texts from the parameters of
    the round before, and the results are averaged. Counts are kept for all words; the ``TOP`` most frequent ones go to the tasks, and
    the others, none of which is frequent, are met by a shuffled join, so that neither a task nor the driver holds the vocabulary.
    """
    spark = docs.sparkSession
    ship_package(spark)
    remainder = F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(fold))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(remainder == held, F.lit(False)).alias("held_out"), F.coalesce(remainder, F.lit((held + 1) % fold)).cast("int").alias("round"))
    counted = texts.where(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, n bigint")
    counts = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    shared = counts.groupBy(shared_class_of(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(SHARED), np.zeros(SHARED)
    for r in shared:
        n[r["c"]], v[r["c"]] = r["n"], r["v"]
    total, different = int(n.sum()), int(v.sum())
    top = _most_frequent(counts)
    for word, times in top[:OWN]:
        n[shared_class(word)] -= times
        v[shared_class(word)] -= 1
    every = np.array([times for _, times in top], dtype=np.float64)
    classes = np.array([SHARED + i if i < OWN else shared_class(w) for i, (w, _) in enumerate(top)], dtype=np.int64)
    in_class = np.log10((every + 0.5) / (n + 0.5 * (v + 1))[np.minimum(classes, SHARED - 1)]) if top else every
    in_class[:OWN] = 0.0
    share = np.concatenate([n, every[:OWN]]) + 0.5
    known = {"words": Words({w: i for i, (w, _) in enumerate(top)}), "class": np.append(classes, 0), "inside": in_class,
        "base": np.log10((every + 0.5) / (total + 0.5 * (different + 1)))}
    id_type = texts.schema["doc_id"].dataType.simpleString()
    encoded = materialize(texts.mapInArrow(partial(_encode, known=spark.sparkContext.broadcast(known)), f"row bigint, doc_id {id_type}, held_out boolean, "
        "round int, n_tokens bigint, n_known bigint, base_score double, inside double, ids binary, rare array<struct<word: binary, n: bigint>>"), "encoded", "zstd")
    model = Model(share / share.sum())
    for round_ in (r for r in range(fold) if r != held):
        state = spark.sparkContext.broadcast({"share": model.share, "flat": model.flat()})
        mine = encoded.where((F.col("round") == round_) & ~F.col("held_out")).select("ids")
        learned = _averaged(mine.coalesce(TRAINERS).mapInArrow(partial(_train, model=state, round_=round_), "tokens bigint, flat array<double>"))
        if learned is not None:
            model.put(learned)
        state.unpersist()
    state = spark.sparkContext.broadcast({"share": model.share, "flat": model.flat()})
    columns = f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = encoded.drop("round", "rare").mapInArrow(partial(_score, model=state), columns)
    rare = encoded.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    met = rare.join(counts.hint("merge"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = F.array(*[F.lit(float(x)) for x in n + 0.5 * (v + 1)])
    more = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (different + 1)))).alias("base"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.get(sizes, shared_class_of(F.col("word"))))).alias("inside"))
    both = scored.join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return both.select("doc_id", "held_out", "n_tokens", plus("n_known", "known"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "base"),
        plus("score", "inside"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: scores of all ``documents``, learned from those whose crc32 of the id is not 1 modulo 5."""
    return score(table(spark, sf_dir, "documents"))
