"""Centroid clustering, hard negatives and language-model scores against brute force on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import centroids, hardneg, logbilinear


def plain_clusters(rows, k, dims, rounds, seed=2):
    """Rows are (id, vector); returns sorted (id, cluster, distance, cluster inertia, inertia, digest)."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, mark(r[0]) if r[0] is not None else "", r[1]))[:k]
    cent = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            cent[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    own = Counter()
    for _, d, n in last:
        own[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, n, d, own[n], sum(own.values()), digest[n]) for i, d, n in last), key=str)


ODD = [(900, None), (901, [1.0, 2.0]), (902, [None, 1.0, 2.0, 3.0]), (903, [float("nan"), 1.0, 2.0, 3.0]), (904, [float("inf"), 1.0, 2.0, 3.0]), (905, [])]


@pytest.mark.parametrize("k,n", [(7, 400), (40, 60), (40, 12), (1, 30)])
def test_clusters_equal_brute_force(spark, k, n):
    rnd = np.random.default_rng(k)
    v = rnd.integers(-4, 5, (n, 4)) / 256  # few different values: many ties and equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[5].tolist()), (5, v[6].tolist()), (None, v[7].tolist()), *ODD]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string")
    want = plain_clusters(rows, k, 4, 3)
    assert sorted(map(tuple, centroids.cluster(df, "vec_id", "embedding", k, 4, 3).collect()), key=str) == want
    if k == 7:
        beside = centroids.with_clusters(df.where("vec_id >= 10"), "vec_id", "embedding", k=k, dims=4, rounds=3)
        assert beside.count() == n - 10 + len(ODD) and {"cluster", "cluster_", "distance"} < set(beside.columns)
    assert centroids.cluster(df.limit(0), "vec_id", "embedding", k, 4, 3).count() == 0


def test_tree_finds_the_nearest_with_ties():
    rnd = np.random.default_rng(3)
    for span in (1, 3, 400):
        c, v = rnd.integers(-span, span + 1, (150, 6)), rnd.integers(-span, span + 1, (3000, 6))
        number, away = centroids.VantageTree(c).nearest(v)
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == d.argmin(axis=1)).all() and (away == d.min(axis=1)).all()


def test_models_beyond_the_bound_and_components_beyond_a_long_are_errors(spark):
    df = spark.createDataFrame([(1, [1e9, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        centroids.cluster(df, "vec_id", "embedding", 1 << 30, 64)
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(df, "vec_id", "embedding", 2, 2).collect()


def plain_negatives(rows, every, positives, negatives):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for n, (i, lab, v) in enumerate(ok):
        if i % every:
            continue
        near = [(-dot(v, w), j, m == lab) for k, (j, m, w) in enumerate(ok) if k != n and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in near if x[2])[:positives]:
            fit = sorted((s, j) for s, j, same in near if not same and -30 * ps <= -100 * s <= -90 * ps)[:negatives]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 150)
    rnd = np.random.default_rng(4)
    v = rnd.integers(-6, 7, (900, 5)) / 256
    label = np.where(rnd.random(900) < 0.4, 3, rnd.integers(0, 12, 900))  # one label holds two fifths
    v[300:340], label[300:340] = v[0], 3  # copies in one block and beyond
    rows = [(i, int(a), x.tolist()) for i, (a, x) in enumerate(zip(label, v, strict=True))]
    rows += [(20, int(label[20]), v[20].tolist()), (40, 7, v[41].tolist()), (60, None, v[1].tolist()), (None, 3, v[1].tolist())]
    rows += [(i + 80, 3, x) for i, x in ODD] + [(2000, 99, v[3].tolist()), (2020, 3, [0.0] * 5), (2040, 3, [1.0, 2.0]), (2041, 4, [0.5, 0.5]), (2042, 3, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, row int, block string")
    ok = hardneg.usable(df, "vec_id", "label", "embedding")
    got = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in hardneg.mine(ok, 20).collect()]
    assert sorted(got) == plain_negatives(rows, 20, 5, 10) and len(got) > 500
    assert hardneg.mine(ok.limit(0), 20).count() == 0


def test_tree_search_opens_few_boxes_of_clustered_rows():
    rnd = np.random.default_rng(5)
    v = (rnd.normal(size=(60, 8))[rnd.integers(0, 60, 6000)] * 400 + rnd.normal(size=(6000, 8)) * 8).astype(np.int64).astype(float)
    tree = hardneg.PackedTree(v, np.zeros(6000, dtype=np.int64), np.arange(6000), np.arange(6000))
    opened, queue = [], tree._queue
    tree._queue = lambda *a: (opened.append(len(a[-2]) * len(a[-1])), queue(*a))[1]
    q, m, s = tree.search(v[:20], np.zeros(20, dtype=np.int64), np.arange(20), np.full(20, -np.inf), np.full(20, np.inf), 5, True)
    for i in range(20):
        d = v @ v[i]
        d[i] = -np.inf
        assert s[q == i].tolist() == sorted(d.tolist(), reverse=True)[:5]
    assert sum(opened) < 20 * len(tree.lo) / 2


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def test_base_scores_equal_brute_force_and_counts_do_not_depend_on_what_tasks_hold(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "a b", "x" * 65, "X" * 70, "q" * 200_000]
    texts = [" ".join(rnd.choice(vocabulary, rnd.integers(0, 60))) for _ in range(120)] + [None, "", "  \n", "word " * 30_000, "THE the\tThe\x0bthe\x1cthe"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "w1 only without id"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, word string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(math.fsum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))
        for i, w in ((i, words_of(t)) for i, t in rows)), key=str)
    for top, counted in ((1 << 17, 1 << 19), (40, 7), (0, 50)):
        monkeypatch.setattr(logbilinear, "TOP", top)
        monkeypatch.setattr(logbilinear, "COUNTED", counted)
        got = logbilinear.score(df).collect()
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert logbilinear.score(df.limit(0)).count() == 0
    alone = logbilinear.score(df.where("doc_id = 1" if held(1) else "false")).collect()  # nothing to learn from
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in alone)


def test_classes_agree_and_probabilities_add_up(spark):
    some = [b"a", b"ab", b"abc", "é".encode(), b"", b"the"]
    df = spark.createDataFrame([(w,) for w in some], "w binary")
    assert [r[0] for r in df.select(logbilinear.shared_class_of(F.col("w"))).collect()] == [logbilinear.shared_class(w) for w in some]
    rnd = np.random.default_rng(7)
    share = rnd.random(50)
    model = logbilinear.Model(share / share.sum())
    for scale in (1, 60):  # the second needs its greatest score taken off
        model.q *= scale
        ids = np.arange(50, dtype=np.int16)
        context = [np.full(50, c, dtype=np.int16) for c in (3, 50, 50)]
        assert abs(np.exp(model.log_probabilities(ids, context)).sum() - 1) < 1e-4
    lengths = np.array([2, 1, 3])
    assert [x.tolist() for x in model.contexts(np.arange(6, dtype=np.int16), lengths)] == [[50, 0, 50, 50, 3, 4], [50, 50, 50, 50, 50, 3], [50] * 6]


def test_unseen_texts_are_more_probable_than_by_word_counts_alone(spark):
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(600):  # two languages: what comes next depends on what came before
        language = "ab"[i % 2]
        rows.append((i, " ".join(f"{language}{rnd.zipf(1.5) % 200}{language}" for _ in range(80))))
    out = logbilinear.score(spark.createDataFrame(rows, "doc_id long, text string"))
    r = out.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.1 * r[2]
