"""Near-dedup against brute force, with links, chains, copies, short, empty and null texts."""

import random

import numpy as np
import pytest

from lakeloom.llm import neardup


def brute(rows):
    sets = {}
    for i, (doc, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc)
    return [(doc, len(sets[i]), min(groups[top(i)])) for i, (doc, _) in enumerate(rows)]


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rnd.randint(30, 400))]
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            near = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 60))):
                near[rnd.randrange(len(near))] = word()
            rows.append(rnd.choice(["  ", "\n", " "]).join(near).upper() if rnd.random() < 0.3 else " ".join(near))
    rows += [None, "", "  \n", "one two", "ONE  two", "one two three", "x " * 50, "x " * 90]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("leaf", [neardup.LEAF, 3])
def test_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "DEPTH", 3 if leaf == 3 else neardup.DEPTH)
    rows = corpus(leaf)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, vid string, node int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


def test_one_of_each_group_stays(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {r["doc_id"] for r in neardup.drop_near_duplicates(df).collect()}
    assert stay == {c for _, _, c in brute(rows)}


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u v")], schema)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(twice).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_rows_without_id_are_linked(spark):
    """A near copy links a row with an id and one without, both ways round; exactly one row of each group stays."""
    rnd = random.Random(3)
    base = [f"w{rnd.random()}" for _ in range(200)]
    near = [*base[:100], "other", *base[101:]]
    rows = [(None, " ".join(base), "a"), (7, " ".join(near), "b"), (None, "lone words of a row without an id", "c"), (None,
        "lone words of a row without an id", "d"), (None, None, "e"), (None, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept_id string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (0, 4, 0), (0, 4, 0), (0, 196, 7), (7, 196, 7)]
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    left = sorted(r["_kept_id"] for r in kept.collect())
    assert left in (["b", "c", "e", "f"], ["b", "d", "e", "f"])


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (1, "x y z", 4), (3, "x y z", 5), (3, "x y z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, vid int")
    got = sorted((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(df).collect())
    assert got == [(1, "a b c d e f"), (1, "x y z")]


def test_words_that_collide_by_construction(spark):
    """Thue-Morse words have equal polynomial hashes modulo 2^64 for every base; they are different words here."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(9))
    df = spark.createDataFrame([(1, f"{one} {rest} {two} {rest}"), (2, f"{one} {rest}"), (3, f"{two} {rest}"), (4, "é" * 300_000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == sorted(brute([tuple(r) for r in df.collect()]))
    assert got[0][1] == 11 + 0 and {r[2] for r in got} == {1, 2, 3, 4}


def test_lower_threshold(spark):
    rnd = random.Random(12)
    base = [f"w{rnd.random()}" for _ in range(300)]
    near = list(base)
    for k in (50, 120, 190, 250, 280):
        near[k] = "other"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    assert neardup.near_duplicates(df).where("component_id = 1").count() == 1
    assert neardup.near_duplicates(df, 80).where("component_id = 1").count() == 2


@pytest.mark.parametrize("kind", ["chain", "apart"])
def test_large_group_that_branches(spark, monkeypatch, kind):
    """A group of four leaves and more: copies of copies, and a template in which pairs are planted."""
    monkeypatch.setattr(neardup, "LEAF", 512)
    rnd = random.Random(kind)
    texts = [[f"t{i}" for i in range(150)]]
    while len(texts) < 2200:
        if kind == "apart" and len(texts) % 2 == 0:
            base, changes = texts[-1], 2
        else:
            base, changes = (texts[max(0, len(texts) - rnd.randint(1, 400))], 1) if kind == "chain" else (texts[0], 4)
        one = list(base)
        for _ in range(changes):
            one[rnd.randrange(150)] = f"v{rnd.random()}"
        texts.append(one)
    rows = [" ".join(t) for t in texts]
    sets = neardup.shingle_sets(rows)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.asarray([len(s) for s in sets])
    first = np.cumsum(size) - size
    root = np.arange(len(rows))
    for i in range(len(rows)):
        has = np.zeros(len(names), dtype=np.int32)
        has[flat[first[i] : first[i] + size[i]]] = 1
        both = np.add.reduceat(has[flat], first)
        for j in np.flatnonzero(100 * both >= 85 * (size + size[i] - both)):
            if root[j] != root[i]:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    wrong = [i for i in range(len(rows)) if got[i] != root[i]]
    print(kind, len(set(root.tolist())), "components,", len(wrong), "rows differ")
    assert len(wrong) <= 0.001 * len(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201)]
    got = {r["vid"]: r["root"] for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}


def test_pairs_of_a_large_family_are_found(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 32)
    rnd = random.Random(8)
    base = [f"t{i}" for i in range(1200)]

    def varied(words, n):
        out = list(words)
        step = len(out) // n
        for k in range(n):
            out[k * step + rnd.randrange(5, step - 5)] = f"v{rnd.random()}"
        return out

    rows = []
    for _ in range(150):
        one = varied(base, 22)  # of two texts with 22 own words each, about 0.7 is common
        rows += [" ".join(one), " ".join(varied(one, 18))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [set(s.tolist()) for s in neardup.shingle_sets(rows)]
    assert all(0.85 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.88 for i in range(0, 300, 2))
    assert max(len(sets[0] & s) / len(sets[0] | s) for s in sets[2:]) < 0.85
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert [i for i in range(0, 300, 2) if got[i] != got[i + 1]] == []


def test_trees_have_values_of_their_own():
    import pyarrow as pa

    texts = [" ".join(f"t{i}" for i in range(1200)), " ".join("v" if i % 60 == 30 else f"t{i}" for i in range(1200))]
    rows = list(neardup._tree_values([pa.RecordBatch.from_pydict({"text": texts})]))[0].to_pylist()
    a, b = ([r["own"] for r in rows[k : k + neardup.TREES]] for k in (0, neardup.TREES))
    assert len({x for own in a for x in own}) > 0.4 * neardup.TREES * neardup.PLACES
    agree = [sum(x == y for x, y in zip(s, t, strict=True)) / neardup.PLACES for s, t in zip(a, b, strict=True)]
    assert len(set(agree)) > 4 and 0.8 < sum(agree) / len(agree) < 0.9
