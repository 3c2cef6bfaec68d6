"""Centroid clustering of integer vectors: a vantage-point tree over the centroids, searched best-first for each vector."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize, ship_package, table, unused

#: Centroids of a leaf; bytes that all centroids may take together, since they are broadcast and meet on the driver.
LEAF, MODEL_BYTES = 6, 64 << 20
#: Vectors times tree nodes whose bounds are held at a time.
FRONTIER = 1 << 21
#: Largest component: squared distances of up to 64 such components fit a long. Relative slack of bounds in doubles.
LIMIT, SLACK = 1 << 27, 1e-9


def scaled(vector: Column, dims: int, factor: int = 256) -> Column:
    """``floor(factor * x)`` of each component as an array of longs; null unless there are exactly ``dims`` components, all finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(factor))))
    return F.when((F.size(v) == dims) & F.coalesce(finite, F.lit(False)), whole)


class VantageTree:
    """Vantage-point tree over integer centroids.

    An inner node holds one centroid and two children, with the least and the greatest distance of their centroids from it; by the triangle
    inequality no centroid of a child is nearer to a vector than the gap between the vector's distance from the vantage point and that range.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.members: list[np.ndarray] = []
        self.children: list[list[tuple[int, float, float]]] = []
        self._grow(np.arange(len(centroids)))

    def _grow(self, members: np.ndarray) -> int:
        node = len(self.members)
        self.members.append(members)
        self.children.append([])
        if len(members) <= LEAF:
            return node
        from_first = squared(self.centroids[members], self.centroids[members[0]])
        top = members[np.argmax(from_first)]
        rest = members[members != top]
        away = np.sqrt(squared(self.centroids[rest], self.centroids[top]).astype(np.float64))
        inside = np.argsort(away, kind="stable")
        self.members[node] = np.array([top])
        for part in np.array_split(inside, 2):
            child = self._grow(rest[part])
            self.children[node].append((child, away[part].min(), away[part].max()))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number.

        Each vector has a frontier of its own: the node with the least bound is opened next, and the search of a vector ends once that
        bound lies above its best distance. A bound equal to it is still opened, since a tie may have a smaller number.
        """
        number, best = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors), dtype=np.int64)
        step = max(1, FRONTIER // len(self.members))
        for lo in range(0, len(vectors), step):
            number[lo : lo + step], best[lo : lo + step] = self._search(vectors[lo : lo + step])
        return number, best

    def _search(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(v)
        bound = np.full((n, len(self.members)), np.inf)
        bound[:, 0] = 0.0
        number, best = np.full(n, len(self.centroids), dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
        live = np.arange(n)
        while len(live):
            node = np.argmin(bound[live], axis=1)
            least = bound[live, node]
            open_ = least * (1 - SLACK) <= np.sqrt(best[live].astype(np.float64))
            live, node = live[open_ & np.isfinite(least)], node[open_ & np.isfinite(least)]
            for k in np.unique(node):
                rows = live[node == k]
                low = bound[rows, k]
                bound[rows, k] = np.inf
                away = None
                for c in self.members[k]:
                    away = squared(v[rows], self.centroids[c])
                    better = (away < best[rows]) | ((away == best[rows]) & (c < number[rows]))
                    best[rows[better]], number[rows[better]] = away[better], c
                for child, near, far in self.children[k]:
                    d = np.sqrt(away.astype(np.float64))
                    gap = np.maximum(near - d, d - far) - SLACK * (d + far)
                    bound[rows, child] = np.maximum(low, gap)
        return number, best


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``a`` from ``b``."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    v = np.asarray(batch.column("v").flatten(), dtype=np.int64).reshape(batch.num_rows, dims)
    if v.size and max(v.max(), -v.min() - 1) > LIMIT:
        raise ValueError(f"a scaled component lies beyond {LIMIT}: squared distances would not fit a long")
    return v


def _sums(batches, tree, dims: int):
    """For each cluster, number and componentwise sums of its vectors in this partition."""
    tree = tree.value
    n, total = np.zeros(len(tree.centroids), dtype=np.int64), np.zeros(tree.centroids.shape, dtype=np.int64)
    for batch in batches:
        v = _matrix(batch, dims)
        number, _ = tree.nearest(v)
        order = np.argsort(number, kind="stable")
        found, first = np.unique(number[order], return_index=True)
        n += np.bincount(number, minlength=len(n))
        if len(found):
            total[found] += np.add.reduceat(v[order], first, axis=0)
    some = np.flatnonzero(n)
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(total[some].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), sums], ["cluster", "n", "s"])


def _assigned(batches, tree, dims: int):
    tree = tree.value
    for batch in batches:
        number, away = tree.nearest(_matrix(batch, dims))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(away)], ["id", "cluster", "distance"])


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``, in that order; equal hashes by components, rows without an id last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster(vectors: DataFrame, id_col: str, vector_col: str, k: int = 40, dims: int = 64, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Assign every vector to one of ``k`` centroids: ``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors with other than ``dims`` components, or with null or non-finite ones, take no part; components become ``floor(256 * x)``, so
    that distances, sums and means are exact integers and don't depend on the order of rows. Repeated rows count as often as they stand,
    rows without an id are assigned too. With fewer than ``k`` vectors each is a centroid; an empty table gives no rows. A component
    beyond 2^19 (2^27 when scaled) is an error, since its squared distance may not fit a long.

    In each round the centroids (at most ``MODEL_BYTES``, which is checked) are broadcast as a vantage-point tree; every partition sends one
    row of sums per cluster, which Spark adds up, so that a cluster with most of the vectors is summed where they lie. The driver sees the
    sums, one row per cluster.
    """
    spark = vectors.sparkSession
    if k * dims * 8 > MODEL_BYTES:
        raise ValueError(f"{k} centroids of {dims} components take more than {MODEL_BYTES} bytes")
    ship_package(spark)
    v = scaled(F.col(vector_col), dims)
    kept = materialize(vectors.select(F.col(id_col).alias("id"), v.alias("v")).where("v IS NOT NULL"), "centroids-vectors")
    centroids = first_centroids(kept, k, seed).reshape(-1, dims)
    if not len(centroids):
        return kept.select("id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256")).where(F.lit(False))
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        sums = kept.select("v").mapInArrow(partial(_sums, tree=tree, dims=dims), "cluster bigint, n bigint, s array<bigint>")
        added = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(dims)]).alias("s")).collect()
        centroids = centroids.copy()
        for r in added:
            centroids[r["cluster"]] = np.array(r["s"], dtype=np.int64) // r["n"]
        tree.unpersist()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    id_type = kept.schema["id"].dataType.simpleString()
    out = materialize(kept.mapInArrow(partial(_assigned, tree=tree, dims=dims), f"id {id_type}, cluster int, distance bigint"), "centroids-assigned")
    sums = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    of_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of_cluster), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def with_clusters(vectors: DataFrame, id_col: str, vector_col: str, **options) -> DataFrame:
    """``vectors`` with all their columns, and ``cluster`` and ``distance`` of each id (lengthened where a column has that name); null for
    vectors that take no part. Ids are taken as unique."""
    number, away = unused(vectors.columns, "cluster", "distance")
    found = cluster(vectors, id_col, vector_col, **options).select(F.col("id").alias("_id"), F.col("cluster").alias(number), F.col("distance").alias(away))
    return vectors.join(found, vectors[id_col] == found["_id"], "left").drop("_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 40 centroids, five rounds, over all ``embeddings`` of 64 components."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


#: The same rounds in SQL, each assigning all vectors to all centroids.
_ROUND = """
a{r} AS MATERIALIZED (SELECT v.row_no, v.q, min_by({{'c': c.c, 'd': {distance}}}, ({distance}, c.c)) AS b FROM v, c{r} c GROUP BY v.row_no, v.q),
c{next} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
    SELECT c, list(f ORDER BY j) AS q FROM (SELECT c, j, CAST(floor(sum(CAST(x AS HUGEINT)) / count(*)) AS BIGINT) AS f FROM (
        SELECT b.c AS c, unnest(range(1, 65)) AS j, unnest(q) AS x FROM a{r}) GROUP BY c, j) GROUP BY c) m ON m.c = c.c),"""
_DISTANCE = "CAST(round(list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q)) AS BIGINT)"


def oracle(rounds: int = 5, k: int = 40) -> str:
    """DuckDB SQL for the rows of the contract query."""
    steps = "".join(_ROUND.format(r=r, next=r + 1, distance=_DISTANCE) for r in range(rounds))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM v ORDER BY sha256('2:' || vec_id), q LIMIT {k}),
{steps}
f AS MATERIALIZED (SELECT v.row_no, v.vec_id, min_by({{'c': c.c, 'd': {_DISTANCE}}}, ({_DISTANCE}, c.c)) AS b FROM v, c{rounds} c GROUP BY v.row_no, v.vec_id)
SELECT f.vec_id, CAST(f.b.c AS INTEGER) AS cluster, f.b.d AS distance, CAST(sum(f.b.d) OVER (PARTITION BY f.b.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(f.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.c = f.b.c"""
