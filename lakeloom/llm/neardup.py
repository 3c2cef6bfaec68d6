"""MinHash near-dedup: chosen-path set similarity join, exact confirmation on full shingle sets, connected components."""

from __future__ import annotations

from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize, ship_package, table, unused

#: Words of a shingle; hundredths of similarity from which documents are linked (the query's contract, and the default).
SHINGLE, PERCENT = 5, 85
#: Minwise values of a document; independent trees; each tree's own values below its root.
VALUES, TREES, PLACES = 64, 16, 48
#: Children of a large root for each member; levels below it. Deeper children are 100 / percent on average.
FIRST, DEPTH = 2, 48
#: Trees whose large roots are first compared in blocks.
FIRST_TREES = 4
#: A node up to so many classes, with so many shingles together, is compared exhaustively; a larger one branches.
LEAF, LEAF_SHINGLES = 4096, 1 << 21
#: Members of a large node that all its blocks meet, so that what blocks find apart is joined.
PIVOTS = 4
#: Standard deviations under the expected number of agreeing minwise values at which a pair isn't confirmed.
SLACK = 5
#: Most rows that a join may broadcast (at most 40 bytes each).
BROADCAST_ROWS = 1_000_000
#: Words of a text that are hashed together; bytes from which a word stands by its own hash.
STRETCH, LONG_WORD = 1 << 18, 1 << 16

_RNG = np.random.default_rng(85)
_MULTIPLIERS = _RNG.integers(1, 1 << 62, VALUES + TREES * PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What finds one row of a class again: its id (or the least long for none) and a hash of its text.
_PLACE = "id_key bigint, text_key bigint"
_NO_ID = -(1 << 63)


def _field(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^63 modulo 2^31 - 1, as numbers below 2^32 + 1."""
    return (x & _PRIME) + (x >> _31)


_PRIME, _31 = np.uint64((1 << 31) - 1), np.uint64(31)
_BASES = [int(x) for x in _RNG.integers(1 << 16, (1 << 31) - 1, 2)]
_LETTERS = _RNG.integers(1, (1 << 31) - 1, (2, 256), dtype=np.uint64)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the two bases its powers and those of its inverse, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        _POWERS.clear()
        for base in _BASES:
            both = []
            for x in (base, pow(base, -1, int(_PRIME))):
                p = np.ones(1, dtype=np.uint64)
                while len(p) < size:  # doubling: the next powers are these times x^len
                    p = np.concatenate([p, p * np.uint64(pow(x, len(p), int(_PRIME))) % _PRIME])
                both.append(p[:size])
            _POWERS.append((both[0], both[1]))
    return _POWERS


def range_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62 bits for each byte range: polynomials modulo 2^31 - 1 at two random points, over random values of the bytes; mixed to 64 bits.

    Prefix sums give every range in constant time. Two ranges of n bytes agree with a chance of (n / 2^31)^2, whatever they hold:
    words that collide by construction for polynomials modulo 2^64 don't here.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    h = np.zeros(len(starts), dtype=np.uint64)
    for letters, (power, inverse) in zip(_LETTERS, _powers(n + 1), strict=True):
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_field(letters[raw] * power[:n]), out=prefix[1:])
        value = _field(_field(prefix[ends] - prefix[starts])) * inverse[starts] % _PRIME
        h = (h << _31) | value
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text. bytes.lower and bytes.split know ASCII only, as wanted.

    Long texts are taken in stretches of ``STRETCH`` words, and a very long word by its cryptographic hash behind a tab (which no
    word holds), so that memory doesn't grow with the length of a text more than its words do.
    """
    out = []
    for text in texts:
        ws = text.encode("utf-8", "surrogatepass").lower().split()
        if len(text) > LONG_WORD:
            ws = [w if len(w) <= LONG_WORD else b"\t" + blake2b(w).digest() for w in ws]
        m = min(k, len(ws))
        parts = [np.zeros(0, dtype=np.uint64)]
        for lo in range(0, len(ws) - m + 1 if ws else 0, STRETCH):
            mine = ws[lo : lo + STRETCH + m - 1]
            data = b" ".join(mine)
            blanks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
            starts, ends = np.concatenate([[0], blanks + 1]), np.append(blanks, len(data))
            parts.append(range_hashes(data, starts[: len(mine) - m + 1], ends[m - 1 :]))
        out.append(np.unique(np.concatenate(parts)))
    return out


def _minwise(sets: list[np.ndarray], multipliers: np.ndarray = _MULTIPLIERS[:VALUES]) -> np.ndarray:
    """One minwise value for each non-empty set and multiplier."""
    flat, first = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(multipliers)), dtype=np.int32)
    for i, m in enumerate(multipliers):
        mixed = flat * m
        mixed ^= mixed >> np.uint64(29)
        out[:, i] = (np.minimum.reduceat(mixed * np.uint64(0x9E3779B97F4A7C15), first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a cryptographic hash over each sorted set, as two columns."""
    both = np.asarray([np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8") for s in sets], dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _keyed(docs: DataFrame) -> DataFrame:
    """What features are made of, with the keys that find a row again (they depend on its content only)."""
    id = F.col("doc_id").cast("long")
    return docs.select(id.alias("doc_id"), F.coalesce(id, F.lit(_NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"), "text")


def _features(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo in range(0, len(texts), 256):
            sets = shingle_sets([t or "" for t in texts[lo : lo + 256]])
            full = [i for i, s in enumerate(sets) if len(s)]
            mins: list = [[]] * len(sets)
            prints = [b""] * len(sets)
            if full:
                values = _minwise([sets[i] for i in full])
                for i, row, low in zip(full, values[:, :TREES], values.astype(np.uint8), strict=True):
                    mins[i], prints[i] = row, low.tobytes()
            n = np.asarray([len(s) for s in sets], dtype=np.int64)
            d1, d2 = _digests(sets)
            kept = [batch.column(c).slice(lo, len(sets)) for c in ("doc_id", "id_key", "text_key")]
            cols = [*kept, pa.array(n), pa.array(d1), pa.array(d2), pa.array(mins, pa.list_(pa.int32())), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "id_key", "text_key", "n_shingles", "d1", "d2", "mins", "prints"])


def features(docs: DataFrame) -> DataFrame:
    """One row per document: size and 128-bit digest of its shingle set, minwise values at the roots of the trees, and one byte of every
    minwise value (``prints``), by which pairs are estimated. One narrow pass over whole texts."""
    return _keyed(docs).mapInArrow(_features, f"doc_id bigint, {_PLACE}, n_shingles bigint, d1 bigint, d2 bigint, mins array<int>, prints binary")


def _tree_values(batches):
    """Each tree's own minwise values of texts, with the digest that tells which class they are of."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo in range(0, len(texts), 64):
            sets = [s for s in shingle_sets([x or "" for x in texts[lo : lo + 64]]) if len(s)]
            if not sets:
                continue
            d = [np.repeat(x, TREES) for x in _digests(sets)]
            rows = pa.FixedSizeListArray.from_arrays(pa.array(_minwise(sets, _MULTIPLIERS[VALUES:]).ravel()), PLACES).cast(pa.list_(pa.int32()))
            tree = pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(d[0]), pa.array(d[1]), tree, rows], ["d1", "d2", "tree", "own"])


def _sets(batches):
    """Full shingle sets of texts, with the digest that tells which class they are of."""
    for batch in batches:
        sets = shingle_sets([x or "" for x in batch.column("text").to_pylist()])
        d1, d2 = _digests(sets)
        yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array([s.tobytes() for s in sets], pa.binary())], ["d1", "d2", "shingles"])


def _small(df: DataFrame) -> DataFrame:
    """``df`` (written already) marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each wanted class (more where a row is repeated); a class is found by the keys of its first row."""
    keys = wanted.select("place.id_key", "place.text_key").distinct()
    return _keyed(docs).join(_small(keys), ["id_key", "text_key"], "left_semi").select("text")


def _blocks(members: DataFrame, everywhere) -> DataFrame:
    """Nodes (``node``, ``vid``, ``size``, ``weight``) dealt into blocks of about half a leaf; members for which ``everywhere``
    holds lie in every block of their node. Sorted arrays of class ids, as ``members``."""
    blocks = F.ceil(F.greatest(F.col("size") / (LEAF // 2), F.col("weight") / (LEAF_SHINGLES // 2))).cast("int")
    own = F.pmod(F.xxhash64("vid", F.lit(5)), blocks).cast("int")
    dealt = F.when(everywhere, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    rows = members.select("node", "vid", F.explode(dealt).alias("block"))
    return rows.groupBy("node", "block").agg(F.sort_array(F.collect_set("vid")).alias("members")).select("members").where(F.size("members") > 1)


def _too_large():
    return (F.col("size") > LEAF) | ((F.col("size") > 2) & (F.col("weight") > LEAF_SHINGLES))


def _root_nodes(classes: DataFrame) -> DataFrame:
    """Each class in the root's child of every tree: the node of its minwise value at the tree's place."""
    roots = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.get("mins", t)).alias("node")))
    return classes.select("vid", "n", F.explode(roots).alias("e")).select("vid", "n", "e.tree", "e.node")


def _own_values(docs: DataFrame, classes: DataFrame, vids: DataFrame) -> DataFrame:
    """``vid``, ``tree`` and the tree's own minwise values, from the texts of the given classes only."""
    wanted = materialize(vids.join(classes.select("vid", "place", "d1", "d2"), "vid"), "large")
    made = _texts_of(docs, wanted).mapInArrow(_tree_values, "d1 bigint, d2 bigint, tree int, own array<int>")
    return materialize(made.join(wanted.select("d1", "d2", "vid"), ["d1", "d2"]).dropDuplicates(["vid", "tree"]).select("vid", "tree", "own"), "own")


def _branch(docs: DataFrame, classes: DataFrame, nodes: DataFrame, percent: int) -> list[DataFrame]:
    """Leaves below large root nodes (``vid``, ``n``, ``tree``, ``node``, ``root``: what the class is joined with so far).

    Only pairs of different ``root`` are still to be found. A node whose members have one root is done and goes, so the
    paths of a group of near copies end as soon as its first blocks have joined it. In others, members with the root
    of one of them (chosen by hash, so likely the most common one) need meeting only with the rest: if the rest is at most half a leaf,
    it lies in every block of the node, exactly and in rows that grow with the node. Else each member takes one or two
    children (``FIRST`` from a root's), named by one of ``PLACES`` minwise values that no other tree uses: paths of a pair
    at the limit are kept up, those of pairs below it fade. What 48 levels don't part is cut into all pairs of blocks;
    that takes some millions of documents that are all just below the limit to each other.
    """
    found: list[DataFrame] = []
    values = None
    for depth in range(DEPTH + 1):
        by_hash = F.xxhash64("vid", "node")
        stats = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("root").alias("lo"),
            F.max("root").alias("hi"), F.min(F.struct(by_hash, "root"))["root"].alias("common"))
        stats = materialize(stats.where("size > 1 AND lo <> hi").drop("lo", "hi"), f"nodes-{depth}")
        met = materialize(nodes.join(_small(stats), "node").withColumn("loose", F.col("root") != F.col("common")), f"paths-{depth}")
        found.append(met.where(~_too_large()).groupBy("node").agg(F.sort_array(F.collect_list("vid")).alias("members")).select("members"))
        large = met.where(_too_large())
        rest = large.groupBy("node").agg(F.count_if("loose").alias("apart"), F.sum(F.when(F.col("loose"), F.col("n")).otherwise(0)).alias("apart_weight"))
        rest = materialize(rest, f"apart-{depth}")
        if rest.isEmpty():
            break
        narrow = (F.col("apart") <= LEAF // 2) & (F.col("apart_weight") <= LEAF_SHINGLES // 2)
        large = materialize(large.join(_small(rest), "node").withColumn("narrow", narrow), f"large-{depth}")
        found.append(_blocks(large.where("narrow"), F.col("loose")))
        large = large.where("NOT narrow")
        if large.isEmpty():
            break
        if depth == DEPTH:
            blocks = F.ceil(F.greatest(F.col("size") / (LEAF // 2), F.col("weight") / (LEAF_SHINGLES // 2))).cast("int")
            dealt = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vid"), blocks).cast("int"))
            pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
            rows = dealt.select("vid", "node", F.explode(pair).alias("pair"))
            found.append(rows.groupBy("node", "pair").agg(F.sort_array(F.collect_list("vid")).alias("members")).select("members"))
            break
        if values is None:
            values = _own_values(docs, classes, large.select("vid").distinct())
        place = lambda b: F.pmod(F.xxhash64(F.col("node"), b), F.lit(PLACES)).cast("int")
        second = (F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(percent)) < 100 - percent).cast("int")
        child = F.transform(F.sequence(F.lit(1), 1 + second if depth else F.lit(FIRST)), lambda b: F.xxhash64("node", b, F.get("own", place(b))))
        nodes = large.join(values, ["vid", "tree"]).select("vid", "n", "tree", "root", F.explode(child).alias("node"))
    return found


def _grouped(batches, key: str):
    """Record batches of rows sorted by ``key`` as tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last > 0 or (held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)]) if last > 0 else pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _split(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


def _bounded(group: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """``group`` as it is if its sets are small together; else every pair of its parts that are (one very long set is a part)."""
    if size[group].sum() <= LEAF_SHINGLES:
        return [group]
    part = np.cumsum(size[group]) // (LEAF_SHINGLES // 2)
    parts = [group[part == p] for p in np.unique(part)]
    return [np.concatenate([parts[i], parts[j]]) for i in range(len(parts)) for j in range(i)] or [group]


def _candidates(batches, percent: int, agree: int):
    """Members of a node in clusters whose minwise values and sizes may reach the similarity and that aren't joined yet; a name for equal clusters."""
    for t in _grouped(batches, "sid"):
        sid, vid, n, joined = (t.column(c).to_numpy() for c in ("sid", "vid", "n", "root"))
        prints = np.frombuffer(b"".join(t.column("prints").to_pylist()), dtype=np.uint8).reshape(len(sid), VALUES)
        keys, members = [], []
        for lo, hi in _split(sid):
            m, size, root = prints[lo:hi], n[lo:hi], joined[lo:hi]
            top = np.arange(hi - lo)
            for first in range(0, hi - lo - 1, 32):
                some = slice(first, min(first + 32, hi - lo - 1))
                same = (m[some, None, :] == m[None, first + 1 :, :]).view(np.uint64).sum(axis=2)  # eight counts of up to eight in one number
                near = (same * np.uint64(0x0101010101010101)) >> np.uint64(56) >= agree
                a, b = size[some, None], size[None, first + 1 :]
                near &= (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (root[some, None] != root[None, first + 1 :])
                for i, row in enumerate(near, first):
                    with_i = top[i + 1 :][row[i - first :]]
                    if (with_i != top[i]).any():
                        both = np.unique(np.append(with_i, top[i]))
                        top[np.isin(top, both)] = both[0]
            if (top == np.arange(hi - lo)).all():
                continue
            order = np.argsort(top, kind="stable")
            groups = [g for g in np.split(order, np.flatnonzero(np.diff(top[order])) + 1) if len(g) > 1]
            for g in [b for g in groups for b in _bounded(g, size)]:
                ids = np.sort(vid[lo:hi][g]).astype(np.uint64)
                mixed = (ids * np.uint64(0xA0761D6478BD642F)) ^ (ids >> np.uint64(32))
                name = int((mixed * np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)) & ((1 << 63) - 1)
                keys.append(np.full(len(g), name, dtype=np.int64))
                members.append(ids.astype(np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(members))], ["cluster", "vid"])


def _confirm(batches, percent: int):
    """What a cluster's links join, each link confirmed on full sets: (smallest member, member) of each group found.

    A member meets all others in one pass over the cluster's shingles; members that are joined already are not compared.
    """
    for t in _grouped(batches, "cluster"):
        cluster, vid, known = (t.column(c).to_numpy() for c in ("cluster", "vid", "root"))
        raw = t.column("shingles")
        a_out, b_out = [], []
        for lo, hi in _split(cluster):
            sets = [np.frombuffer(raw[i].as_py(), dtype=np.uint64) for i in range(lo, hi)]
            order = np.argsort(vid[lo:hi])
            sets, ids = [sets[i] for i in order], vid[lo:hi][order]
            size = np.asarray([len(x) for x in sets])
            first = np.cumsum(size) - size
            _, start = np.unique(known[lo:hi][order], return_inverse=True)
            root = np.asarray([np.flatnonzero(start == s)[0] for s in range(start.max() + 1)])[start]
            before = root.copy()
            _, which = np.unique(np.concatenate(sets), return_inverse=True)
            has = np.zeros(int(which.max()) + 1, dtype=np.int32)
            for i in range(hi - lo - 1):
                if (root[i + 1 :] == root[i]).all():
                    continue
                own = which[first[i] : first[i] + size[i]]
                has[own] = 1
                both = np.add.reduceat(has[which], first)
                has[own] = 0
                linked = np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (root != root[i]))
                for r in np.unique(root[linked]).tolist():
                    low, high = min(r, root[i]), max(r, root[i])
                    root[root == high] = low
            joined = np.flatnonzero(root != before)
            a_out.append(ids[root[joined]])
            b_out.append(ids[joined])
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out), pa.int64()), pa.array(np.concatenate(b_out), pa.int64())], ["a", "b"])


def _links(docs: DataFrame, classes: DataFrame, leaves: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that join what the leaves hold: candidates by minwise values, confirmed on sets from their whole texts."""
    agree = int(VALUES * percent / 100 - SLACK * (VALUES * percent * (100 - percent)) ** 0.5 / 100)
    leaves = materialize(leaves.where(F.size("members") > 1).distinct().withColumn("sid", F.monotonically_increasing_id()), "leaves")
    members = leaves.select("sid", F.explode("members").alias("vid")).join(classes.select("vid", "n", "root", "prints"), "vid")
    by_leaf = members.repartition("sid").sortWithinPartitions("sid").select("sid", "vid", "n", "root", "prints")
    clusters = materialize(by_leaf.mapInArrow(partial(_candidates, percent=percent, agree=agree), "cluster bigint, vid bigint").distinct(), "clusters")
    wanted = materialize(clusters.select("vid").distinct().join(classes.select("vid", "root", "place", "d1", "d2"), "vid"), "wanted")
    sets = _texts_of(docs, wanted).mapInArrow(_sets, "d1 bigint, d2 bigint, shingles binary").join(wanted.select("d1", "d2", "vid", "root"), ["d1", "d2"])
    sets = sets.select("vid", "root", "shingles").dropDuplicates(["vid"])
    by_cluster = clusters.join(sets, "vid").repartition("cluster").sortWithinPartitions("cluster").select("cluster", "vid", "root", "shingles")
    return materialize(by_cluster.mapInArrow(partial(_confirm, percent=percent), "a bigint, b bigint"), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """``vid`` and ``root``, the smallest vid reachable, for every vid in ``edges`` (``a``, ``b``).

    Alternating large-star and small-star steps: every round links vertices straight to smaller ones, with map-side
    minima, and the number of rounds grows with the logarithm of the longest path. Lineage is cut each round; nothing but
    one count and one checksum reach the driver. A vertex of any degree is spread over tasks by the minimum's partial aggregation.
    """
    links = materialize(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())
    before = mark(links)
    while True:
        # large star: link every larger neighbour of a vertex, and itself, to the smallest of its neighbourhood
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v")
        # small star: link the smaller neighbours of a vertex, and itself, to the smallest of them
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lower, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        links = materialize(small, "links")
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("v").alias("vid"), F.col("u").alias("root"))


def _classes_with_roots(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with ``root``: the smallest class that the links join each one with."""
    return classes.drop("root").join(connected_components(links), "vid", "left").withColumn("root", F.coalesce("root", "vid"))


def _first_roots(vids: DataFrame, links: DataFrame) -> DataFrame:
    """``vid`` and ``root`` for the given classes: the least class that a link leads to, and two steps on from there.

    Equal roots are of one component; not all of one need be equal, since that only decides what is still to be compared.
    """
    least = links.groupBy(F.col("b").alias("vid")).agg(F.min("a").alias("root")).where("root < vid")
    least = _small(materialize(least, "first-roots"))
    out = vids.join(least, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    for _ in range(2):
        further = least.select(F.col("vid").alias("root"), F.col("root").alias("_further"))
        out = out.join(further, "root", "left").select("vid", F.coalesce("_further", "root").alias("root"))
    return out


def _joined(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(features of all rows, classes of equal shingle sets with their final ``root``)."""
    ship_package(docs.sparkSession)
    found = materialize(features(docs), "minwise")
    real = found.where("n_shingles > 0")
    place = F.min(F.struct("id_key", "text_key")).alias("place")
    classes = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), place, F.first("n_shingles").alias("n"), F.first("mins").alias("mins"),
        F.first("prints").alias("prints"))
    classes = classes.withColumn("vid", F.monotonically_increasing_id())
    classes = materialize(classes.withColumn("root", F.col("vid")), "classes")
    nodes = _root_nodes(classes)
    large = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), *[_pivot(i).alias(f"p{i}") for i in range(PIVOTS)]).where(_too_large())
    large = materialize(large, "large-roots")
    mine = _small(large)
    leaves = nodes.join(mine.select("node"), "node", "left_anti").groupBy("node").agg(F.sort_array(F.collect_list("vid")).alias("members")).select("members")
    if large.isEmpty():
        return found, _classes_with_roots(classes, _links(docs, classes, leaves, percent))
    held = materialize(nodes.join(mine, "node"), "large-members")
    is_pivot = F.coalesce(F.col("vid").isin(*[F.col(f"p{i}") for i in range(PIVOTS)]), F.lit(False))
    first = _links(docs, classes, _blocks(held.where(F.col("tree") < FIRST_TREES), is_pivot), percent)
    roots = materialize(_first_roots(held.select("vid").distinct(), first), "first-roots")
    nodes = held.select("vid", "n", "tree", "node").join(_small(roots), "vid")
    for more in _branch(docs, classes, nodes, percent):
        leaves = leaves.unionByName(more)
    known = classes.drop("root").join(_small(roots), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    second = _links(docs, known, leaves, percent)
    return found, _classes_with_roots(classes, first.unionByName(second))


def _pivot(i: int):
    """The member of a node that comes first by hash among those of one of ``PIVOTS`` shares."""
    mine = F.pmod(F.xxhash64("vid", F.lit(6)), F.lit(PIVOTS)) == i
    return F.min(F.when(mine, F.struct(F.xxhash64("vid", "node"), "vid")))["vid"]


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id linked with it, directly or not) and ``kept``, one row per row of ``docs``.

    Documents with one shingle set are one class and linked (groups of copies of any size become one row, by map-side
    minima). The chosen-path trees find candidates among classes; links are confirmed on full sets, whose texts are read again for
    candidates only. A node is compared exhaustively up to ``LEAF`` classes and ``LEAF_SHINGLES`` shingles, so that a task's memory doesn't
    grow with the texts. A larger root (of the first ``FIRST_TREES`` trees) is first cut into blocks, which its ``PIVOTS`` all meet: a group of near copies is joined there in rows that
    grow with the group. What then is not joined branches further (see ``_branch``). Links that a node confirms form a forest, never all
    its pairs. A pair at the limit shares a root node with probability 0.85 in each of 16 trees.

    Null and empty texts have no shingles, are linked with nothing and kept. Rows that share an id but not their text are documents
    of their own. Rows without an id are linked like others, but give a component its id only if it has no other: then ``component_id`` is null.
    Repeated rows get equal answers. Columns other than ``doc_id`` and ``text`` don't matter.
    """
    found, classes = _joined(docs, percent)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ends = classes.select("d1", "d2", "root").join(least, "root").select("d1", "d2", "component_id")
    out = found.where("n_shingles > 0").join(ends, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each component: that of the smallest id (rows without an id come last); columns stay.

    Rows are told apart by id and text; of rows that agree in both, one stays. Texts without words all stay. Texts
    don't move, but for rows that are repeated.
    """
    found, classes = _joined(docs, percent)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "id_key", "text_key")
    rows = found.where("n_shingles > 0").join(classes.select("d1", "d2", "root"), ["d1", "d2"])
    stay = rows.groupBy("root").agg(F.min(key).alias("key")).select("key.id_key", "key.text_key")
    alone = found.where("n_shingles = 0").select("id_key", "text_key").distinct()
    times = rows.groupBy("id_key", "text_key").agg(F.count(F.lit(1)).alias("times"))
    stay = stay.join(times, ["id_key", "text_key"]).unionByName(alone.withColumn("times", F.lit(1).cast("long")))
    kept_id, kept_text, kept_times, kept_place = unused(docs.columns, "_kept_id", "_kept_text", "_kept_times", "_kept_place")
    stay = materialize(stay.select(F.col("id_key").alias(kept_id), F.col("text_key").alias(kept_text), F.col("times").alias(kept_times)), "kept-rows")
    id, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.xxhash64("text")
    held = docs.join(stay, (id == F.col(kept_id)) & (text == F.col(kept_text)))
    by_row = Window.partitionBy(kept_id, kept_text).orderBy(F.lit(0))
    again = held.where(F.col(kept_times) > 1).withColumn(kept_place, F.row_number().over(by_row)).where(F.col(kept_place) == 1)
    return held.where(F.col(kept_times) == 1).select(*docs.columns).unionByName(again.select(*docs.columns))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: shingle set size and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
