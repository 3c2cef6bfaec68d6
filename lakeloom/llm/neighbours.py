"""Approximate nearest neighbours by collision counting over single projections."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import ship_package, table

#: Projections, share of them in which a vector must collide, half width of a window at radius 1.
PROJECTIONS, COLLIDE, HALF_WIDTH = 64, 0.75, 1.35
#: Radii of virtual rehashing: the first, the factor to the next; the largest distance of unit vectors is 2.
FIRST_RADIUS, FACTOR = 0.1, 1.25
#: Vectors of a block, which a task indexes.
VECTOR_BLOCK = 8192


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``v`` (doubles) and ``dim``, without vectors that are null, zero or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0),
        F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Vectors of a batch as rows, each times a power of two that brings its largest component near 1: exact, and no norm overflows or vanishes."""
    v = np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


class SortedProjections:
    """One sorted array of values for each projection of a block of unit vectors."""

    def __init__(self, unit: np.ndarray, seed: int):
        self.axes = np.random.default_rng(seed).standard_normal((unit.shape[1], PROJECTIONS))
        values = unit @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(values, self.order.T, axis=0).T.copy()

    def search(self, q: np.ndarray, k: int, measure) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) that were verified for unit query ``q``: windows around its projections grow with the radius; a row
        that lies in ``COLLIDE`` of them is verified by ``measure``; it ends once the k-th best distance is within the radius."""
        n = self.order.shape[1]
        least = math.ceil(COLLIDE * PROJECTIONS)
        levels = int(math.log(2.0 / FIRST_RADIUS) / math.log(FACTOR)) + 2
        radii = FIRST_RADIUS * FACTOR ** np.arange(levels)
        centre = q @ self.axes
        edges = np.stack([np.searchsorted(v, np.concatenate([c - HALF_WIDTH * radii, c + HALF_WIDTH * radii])) for v, c in zip(self.values, centre, strict=True)])
        lo, hi = edges[:, :levels], edges[:, levels:]
        counts = np.zeros(n, dtype=np.int64)
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        was_lo = was_hi = None
        for t, r in enumerate(radii):
            if was_lo is None:
                parts = [o[a:b] for o, a, b in zip(self.order, lo[:, t], hi[:, t], strict=True)]
            else:
                parts = [o[a:b] for o, a, b in zip(self.order, lo[:, t], was_lo, strict=True)] + [o[a:b] for o, a, b in zip(self.order, was_hi, hi[:, t], strict=True)]
            was_lo, was_hi = lo[:, t], hi[:, t]
            counts += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((counts >= least) & ~seen)
            if len(new):
                seen[new] = True
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, measure(new)])
            good = scores[scores > -2]
            if len(good) >= k and 2 - 2 * np.partition(good, -k)[-k] <= r * r:
                return rows, scores
        new = np.flatnonzero(~seen)  # fewer than k within reach: the block has no more to offer than all it holds
        return np.concatenate([rows, new]), np.concatenate([scores, measure(new)])


def _search(batches, k: int, seed: int):
    """Hits of rows sorted by (dim, block, kind): a block's vectors (kind 0) are indexed once, then its queries stream past the index."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    block = index = None
    for whole in batches:
        keys = np.stack([whole.column(c).to_numpy() for c in ("dim", "block", "kind")], axis=1).astype(np.int64)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if lo == hi:
                continue
            batch, mine = whole.slice(lo, hi - lo), tuple(keys[lo, :2].tolist())
            if mine != block:
                block, held, index = mine, [], None
            found, v = batch.column("vec_id").to_numpy(), _rows(batch, "v")
            norms = np.sqrt((v * v).sum(axis=1))
            if keys[lo, 2] == 0:
                held.append((found, v, norms))
                continue
            if not held:
                continue
            if index is None:
                ids, all_v, all_norms = (np.concatenate(x) for x in zip(*held, strict=True))
                index = SortedProjections(all_v / all_norms[:, None], seed)
            out = []
            for i, q_id in enumerate(found):

                def measure(rows, i=i, q_id=q_id):
                    s = (all_v[rows] * v[i]).sum(axis=1) / (all_norms[rows] * norms[i])
                    return np.where(ids[rows] == q_id, -3.0, s)

                rows, scores = index.search(v[i] / norms[i], k, measure)
                own = scores > -2
                rows, scores = rows[own], scores[own]
                best = np.lexsort((ids[rows], -scores))[:k]
                out.append((np.full(len(best), q_id), ids[rows[best]], scores[best]))
            q, i, x = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(x, pa.float64())], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, seed: int = 3) -> DataFrame:
    """The ``k`` vectors with the largest cosine to each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Both frames come from ``usable``: rows without an id, and vectors that are null, zero or not finite, take no part; very large and very
    small components do. Vectors are dealt by hash into blocks of ``VECTOR_BLOCK``; each block of one dimension is indexed once, and all queries
    stream past it in batches, so that every row is indexed, a task's memory is that of a block, and nothing that grows is broadcast. The k best of each
    block, by exact cosine in double precision, meet in a window of k rows per block and query; ties go to the smaller id. Rows with the query's own id are no
    candidates. Equal rows of one id are held once (any number of them would be one block) and count as often as they stand; equal queries are
    one. With fewer candidates than k all are returned.
    """
    ship_package(vectors.sparkSession)
    once = vectors.groupBy("vec_id", "v", "dim").agg(F.count(F.lit(1)).alias("times"))
    nv = max(1, math.ceil(vectors.count() / VECTOR_BLOCK))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(nv))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long")))
    left = once.select("dim", block.alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    right = queries.select("vec_id", "v", "dim").distinct().select("dim", every.alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = left.unionByName(right).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind")
    found = dealt.mapInArrow(partial(_search, k=k, seed=seed), "query_id bigint, vec_id bigint, score double")
    again = once.where("times > 1").groupBy("vec_id").agg(F.max("times").alias("times"))
    found = found.join(again.hint("merge"), "vec_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("times", F.lit(1)), F.lit(k)).cast("int"))))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 5 nearest of every vector whose id is divisible by 50, among all others."""
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
