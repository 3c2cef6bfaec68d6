"""Hard negatives: inner products searched best-first in R-trees that are packed by sort-tile-recursive, one tree per block of rows."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import distributed_rank, materialize, ship_package, table

#: Rows of a block, of a leaf, and children of an inner node.
BLOCK, LEAF, FANOUT = 8192, 32, 8
#: Queries times nodes whose bounds are held at a time.
FRONTIER = 1 << 21
#: Scores below this are exact in doubles.
EXACT = 1 << 53

WINDOWS = "array<struct<nth: bigint, positive_id: bigint, positive_score: bigint>>"
HITS = "anchor bigint, anchor_id bigint, nth bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


class PackedTree:
    """R-tree over integer vectors with labels.

    Rows of one label are sorted by one coordinate after the other and cut into tiles (sort-tile-recursive), along as many of the widest
    coordinates as the number of leaves can halve. Each node holds the least and the greatest value of every coordinate and of the label.
    """

    def __init__(self, v: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        by_label = np.argsort(label, kind="stable")
        order = np.concatenate([self._tiles(v, m) for m in np.split(by_label, np.flatnonzero(np.diff(label[by_label])) + 1)])
        self.v, self.label, self.ids, self.rows = v[order], label[order], ids[order], rows[order]
        starts = np.arange(0, len(order), LEAF)
        lo, hi = np.minimum.reduceat(self.v, starts, axis=0), np.maximum.reduceat(self.v, starts, axis=0)
        first, last = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
        levels = [(lo, hi, first, last)]
        while len(levels[-1][0]) > 1:
            lo, hi, first, last = levels[-1]
            cut = np.arange(0, len(lo), FANOUT)
            levels.append((np.minimum.reduceat(lo, cut, axis=0), np.maximum.reduceat(hi, cut, axis=0), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)))
        self.lo, self.hi, self.first, self.last = (np.concatenate(x) for x in zip(*levels, strict=True))
        self.starts, self.children, base = starts, {}, 0
        for below, level in zip(levels, levels[1:], strict=False):
            size, up = len(below[0]), base + len(below[0])
            for i in range(len(level[0])):
                self.children[up + i] = np.arange(base + i * FANOUT, min(base + (i + 1) * FANOUT, base + size))
            base = up
        self.root = len(self.lo) - 1

    def _tiles(self, v: np.ndarray, members: np.ndarray) -> np.ndarray:
        leaves = -(-len(members) // LEAF)
        axes = np.argsort(-np.ptp(v[members], axis=0), kind="stable")[: max(0, math.ceil(math.log2(leaves)))] if leaves > 1 else []
        return self._cut(v, members, list(axes))

    def _cut(self, v: np.ndarray, members: np.ndarray, axes: list) -> np.ndarray:
        leaves = -(-len(members) // LEAF)
        if leaves <= 1 or not axes:
            return members
        slabs = math.ceil(leaves ** (1 / len(axes)))
        members = members[np.argsort(v[members, axes[0]], kind="stable")]
        size = -(-leaves // slabs) * LEAF
        return np.concatenate([self._cut(v, members[i : i + size], axes[1:]) for i in range(0, len(members), size)])

    def _bounds(self, a: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each row of ``a`` with any vector of each node's box: each coordinate takes one end of its range."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        lo, hi = self.lo[nodes].T, self.hi[nodes].T
        return up @ lo + down @ hi, up @ hi + down @ lo

    def search(self, a: np.ndarray, label: np.ndarray, own: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(query, member, score) of the ``k`` best members of each query whose score lies in [least, most], with the query's label or
        (not ``same``) with another, without the query's own row; by score, then by smaller id.

        Every query has a queue of its own: the box with the greatest bound is opened next, and the search of a query ends when that
        bound lies strictly below its k-th score. Boxes outside the window, or without a wanted label, are never queued.
        """
        n = len(a)
        bound = np.full((n, self.root + 1), -np.inf)
        best, ids, member = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        self._queue(bound, a, label, least, most, same, np.arange(n), np.array([self.root]))
        live = np.arange(n)
        while len(live):
            node = np.argmax(bound[live], axis=1)
            top = bound[live, node]
            go = np.isfinite(top) & (top >= best[live, -1])
            live, node = live[go], node[go]
            for x in np.unique(node).tolist():
                q = live[node == x]
                bound[q, x] = -np.inf
                if x in self.children:
                    self._queue(bound, a, label, least, most, same, q, self.children[x])
                    continue
                at = np.arange(self.starts[x], min(self.starts[x] + LEAF, len(self.v)))
                s = a[q] @ self.v[at].T
                fits = (s >= least[q, None]) & (s <= most[q, None]) & (s >= best[q, -1:]) & (self.rows[at] != own[q, None])
                fits &= (self.label[at] == label[q, None]) == same
                some = fits.any(axis=1)
                q, s = q[some], np.where(fits[some], s[some], -np.inf)
                if len(q):
                    all_s = np.concatenate([best[q], s], axis=1)
                    all_ids = np.concatenate([ids[q], np.broadcast_to(self.ids[at], s.shape)], axis=1)
                    all_at = np.concatenate([member[q], np.broadcast_to(at, s.shape)], axis=1)
                    pick = np.lexsort((all_ids, -all_s), axis=1)[:, :k]
                    best[q], ids[q], member[q] = (np.take_along_axis(y, pick, axis=1) for y in (all_s, all_ids, all_at))
        q, j = np.nonzero(np.isfinite(best))
        return q, member[q, j], best[q, j]

    def _queue(self, bound, a, label, least, most, same, q, nodes) -> None:
        low, high = self._bounds(a[q], nodes)
        of, first, last = label[q, None], self.first[nodes], self.last[nodes]
        wanted = (first <= of) & (of <= last) if same else (first != of) | (last != of)
        bound[np.ix_(q, nodes)] = np.where(wanted & (high >= least[q, None]) & (low <= most[q, None]), high, -np.inf)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def _search(batches, k: int, same: bool):
    """Hits of rows sorted by (dim, block, kind): a block's rows (kind 0) become a tree, then its queries stream past it."""
    held: list[tuple[np.ndarray, ...]] = []
    block = tree = None
    for whole in batches:
        keys = np.stack([whole.column(c).to_numpy() for c in ("dim", "block", "kind")], axis=1).astype(np.int64)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if lo == hi:
                continue
            batch, mine = whole.slice(lo, hi - lo), tuple(keys[lo, :2].tolist())
            if mine != block:
                block, held, tree = mine, [], None
            row, ids, label = (batch.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            v = _vectors(batch)
            if keys[lo, 2] == 0:
                held.append((v, label, ids, row))
                continue
            if not held:
                continue
            if tree is None:
                tree = PackedTree(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if v.size and np.abs(v).max() * np.abs(tree.v).max() * v.shape[1] * 90 >= EXACT:
                raise ValueError("components too large: their inner products would not be exact")
            windows = batch.column("windows")
            nth, positive, score = (np.asarray(pc.struct_field(windows.flatten(), c)) for c in ("nth", "positive_id", "positive_score"))
            of = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(windows)))
            least, most = (-np.inf, np.inf) if same else (-(-30 * score // 100), 90 * score // 100)
            least, most = (np.broadcast_to(x, len(of)).astype(np.float64) for x in (least, most))
            step = max(1, FRONTIER // (tree.root + 1))
            for i in range(0, len(of), step):
                at = of[i : i + step]
                q, m, s = tree.search(v[at], label[at], row[at], least[i : i + step], most[i : i + step], k, same)
                cols = [row[at][q], ids[at][q], *(x[i : i + step][q] for x in (nth, positive, score)), tree.ids[m], s.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in HITS.split(", ")])


def _best(blocks: DataFrame, queries: DataFrame, k: int, same: bool, group: list[str]) -> DataFrame:
    """The ``k`` best hits of each query over all blocks that it was sent to; k rows of each block and query meet in a window."""
    left = blocks.select("dim", "block", F.lit(0).alias("kind"), "row", "vec_id", "label", "v", F.lit(None).cast(WINDOWS).alias("windows"))
    right = queries.select("dim", "block", F.lit(1).alias("kind"), "row", "vec_id", "label", "v", "windows")
    dealt = left.unionByName(right).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind")
    hits = dealt.mapInArrow(partial(_search, k=k, same=same), HITS)
    by = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, factor: int = 256) -> DataFrame:
    """``vec_id``, ``label``, ``v`` (``floor(factor * x)``) and ``dim``, without rows whose id, label, vector or any component is null or not finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x * F.lit(float(factor)))).alias("v"), F.size(v).alias("dim"))


def mine(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Hard negatives of the rows whose ``vec_id`` is divisible by ``every``, with respect to each of their first positives.

    ``vectors`` comes from ``usable``. Rows are rows: a copy of an anchor is another row, and an anchor itself. Vectors of different
    lengths never meet. No anchor, no positive or no row in a window: no result rows. Positives with a negative score have an empty
    window. Scores that 90 times would pass 2^53 are an error, as doubles would not hold them.

    Rows are ranked by (label, first coordinate) and cut into blocks of ``BLOCK``, so that a label with most of the rows is many blocks and
    rare labels share one. Anchors go to the blocks that hold their label, then, with the windows that their positives give, to all blocks;
    each block is packed into a tree once and the anchors stream past it. Nothing is broadcast or collected.
    """
    ship_package(vectors.sparkSession)
    rows = materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "hardneg-rows")
    ranked = distributed_rank(rows.withColumn("lead", F.coalesce(F.get("v", F.lit(0)), F.lit(0))), ["dim"], ["label", "lead", "row"], "hardneg-ranked")
    blocks = materialize(ranked.select("dim", F.floor(F.col("rank") / BLOCK).alias("block"), "row", "vec_id", "label", "v"), "hardneg-blocks")
    anchors = rows.where(F.col("vec_id") % every == 0)
    one = F.from_json(F.lit('[{"nth": 0, "positive_id": 0, "positive_score": 0}]'), WINDOWS)
    homes = blocks.select("dim", "label", "block").distinct()
    near = _best(blocks, anchors.join(homes, ["dim", "label"]).withColumn("windows", one), positives, True, ["anchor"])
    windows = near.where("score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_list(
        F.struct(F.col("rank").cast("long").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("windows"))
    found = materialize(anchors.join(windows, "row"), "hardneg-windows")
    count = blocks.groupBy("dim").agg(F.max("block").alias("last"))
    sent = found.join(count, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    best = _best(blocks, sent, negatives, False, ["anchor", "nth"])
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: anchors are the rows of ``embeddings`` whose id is divisible by 100; ids divisible by 7 get the next label."""
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), 100)


ORACLE = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q, len(embedding) AS dim
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_inner_product(a.q, o.q) AS BIGINT) AS score
    FROM v a JOIN v o ON a.dim = o.dim AND a.r <> o.r WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS n
    FROM s WHERE same QUALIFY n <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS "rank",
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY "rank" <= 10"""
