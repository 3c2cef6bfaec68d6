"""The pipeline: every stage and the whole against brute force, and on odd tables."""

import collections
import pathlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lakeloom.llm import common, mixing, packing, quality, tokens
from lakeloom.llm.common import dropped_after, materialize
from tests.conftest import SF
from tests.llm.test_native import WORD, water_fill, without_later_copies

STAGES = dict(corpus_pipeline.STAGES)


def near_groups(rows, percent):
    """Smallest id of each one's group by all pairs; None for texts without words."""
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((root[a], root[b]))
                    root = {d: low if r == high else r for d, r in root.items()}
    return {d: r if sets[d] else None for d, r in root.items()}


def corpus():
    """Documents with near copies (some between 0.80 and 0.85), shared passages, repeated and junk texts; labels for most."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    passage = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))
    rows = []
    for i in range(60):
        lines = [[word() for _ in range(rnd.randint(6, 14))] for _ in range(rnd.randint(5, 15))]
        text = "\n".join(" ".join(x) for x in lines)
        rows.append(f"{text}\n{passage}" if i % 7 == 0 else text)
        if i % 5 == 0:
            flat = text.split(" ")
            for k in range(rnd.randint(1, max(1, len(flat) // 70))):
                flat[rnd.randrange(len(flat))] = word()
            rows.append(" ".join(flat).replace("\n", " "))
        if i % 5 == 1:  # every fiftieth word is another one: about 0.82 is common
            flat = text.replace("\n", " ").split(" ")
            flat[25::50] = [word() for _ in flat[25::50]]
            rows.append(" ".join(flat))
        for _ in range(2):
            rows.append(" ".join(word().upper() + "$$!!" for _ in range(60)))
        if i % 9 == 0:
            rows.append("too short " + word())
            rows.append(" ".join(["again and again the very same words here now"] * 12))
    docs = [(k, t, "en", rnd.choice(["hot", "hot", "hot", "b", None]), len(t)) for k, t in enumerate(rows)]
    labels = [(k, int("$$" not in t), 0) for k, t, *_ in docs if k % 7]
    return docs, labels


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Each stage on what the one before it kept, with what it was given and what it returned."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given, now = now, materialize(stage(spark, now, folder), name)
        out[name] = (given, now)
    return folder, out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_quality_stage(spark, run):
    folder, out = run
    given, kept = out["quality_rules"]
    rules = quality.fit_decision_list(given, spark.read.parquet(f"{folder}/labels.parquet"), base=False)
    marks = {r["doc_id"]: r for r in quality.with_statistics(given.select("doc_id", "text")).select("doc_id", *[c.alias(k) for k,
        c in quality.feature_columns().items()]).collect()}
    want = []
    for d, t in pairs(given):
        hit = any(all(marks[d][f] <= v if op == "<=" else marks[d][f] > v for f, op, v in rule) for rule in rules)
        if not hit:
            want.append((d, t))
    assert pairs(kept) == want and 0 < len(want) < given.count()
    assert not any("$$" in t for _, t in want) and any(t.startswith("too short") for _, t in want)


def test_line_stage(run):
    given, kept = run[1]["line_dedup"]
    assert pairs(kept) == sorted(without_later_copies(pairs(given), 50).items())
    assert pairs(kept) != pairs(given)


def test_near_stage(run):
    given, kept = run[1]["near_dedup"]
    rows = pairs(given)
    groups = near_groups(rows, corpus_pipeline.PERCENT)
    assert pairs(kept) == [(d, t) for d, t in rows if groups[d] in (d, None)]
    assert len(pairs(kept)) < len(rows) and groups != near_groups(rows, 85)  # some lie between the two limits


def test_mix_stage(run):
    given, kept = run[1]["mix_sources"]
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in given.collect()}
    source = {r["doc_id"]: r["source"] for r in given.collect()}
    taken = collections.Counter(r["doc_id"] for r in kept.collect())
    sums = collections.Counter()
    for d, n in size.items():
        sums[source[d]] += n
    order = sorted([s for s in sums if s is not None]) + [None]
    want = water_fill(sums, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, mixing.SHARE * sum(sums.values()))
    assert max(taken.values()) <= 2 and set(taken) <= set(size)
    for s in order:
        assert abs(sum(n * size[d] for d, n in taken.items() if source[d] == s) - want[s]) <= max(n for d, n in size.items() if source[d] == s)


def check_pieces(docs, pieces):
    enc = tokens.encoder(tokens.public_path(corpus_pipeline.TOKENIZER)).tokenizer
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append(np.asarray(enc.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4"))
    used = collections.defaultdict(list)
    total = collections.Counter()
    for r in pieces.collect():
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        total[r["doc_id"]] += r["length"]
    assert total == {d: sum(map(len, x)) for d, x in ids.items()}
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= packing.WINDOW


def test_pack_stage(run):
    given, pieces = run[1]["pack"]
    check_pieces(pairs(given), pieces)


def test_the_whole(spark, run):
    """run() gives the rows of the stages in a row."""
    folder, out = run
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    got = key(corpus_pipeline.run(spark, folder))
    assert sum(r[2] for r in got) == sum(r[2] for r in key(out["pack"][1]))
    check_pieces(pairs(out["pack"][0]), corpus_pipeline.run(spark, folder))


def test_stages_on_the_given_tables(spark):
    assert list(STAGES) == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows.append(docs.count())
    assert rows[1] < rows[0] and rows[2] == rows[1] and rows[3] <= rows[2] and rows[4] > rows[3]


CLASHING = "_id string, _k1 string, _k2 int, _copies int, _copy int, gone int, _w int, _c int, _kept boolean, _rule int, vid int, node int, _doc int, rank int, bin int"


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, rows without an id, columns by any name; then no rows at all."""
    line = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(" ".join(f"x{i}y{j}" for j in range(20)) for i in range(4000))
    texts = [(1, line, "a"), (1, line, "a"), (2, f"{line}\n{line}", None), (None, line, "a"), (None, None, None), (3, "", "b"), (4, None, "b"), (5, long, "a"), (5, long, "a")]
    extra = (None,) * len(CLASHING.split(","))
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    docs = spark.createDataFrame([(d, t, None, s, None, *extra) for d, t, s in texts], schema)
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, SF), name)
            assert now.columns == docs.columns, name
        pieces = STAGES["pack"](spark, now, SF)
        assert pieces.count() == 0 if table is not docs else pieces.count() > 0
    for name in ("line_dedup", "near_dedup", "mix_sources"):
        got = [(r["doc_id"], r["text"]) for r in STAGES[name](spark, docs, SF).collect()]
        if name == "line_dedup":  # rows stay; the row without an id is the first copy
            assert len(got) == len(texts) and (1, "") in got and got.count((None, line)) == 1
        if name == "near_dedup":  # one of each group, all without words
            assert len(got) == 5 and sum(re.search(r"\S", t or "") is not None for _, t in got) == 2
        if name == "mix_sources":
            assert all(t for _, t in got)


def test_tables_of_a_step_go_when_its_result_stands(spark, folder, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: folder)
    with dropped_after(spark):
        inner = materialize(spark.range(5), "inner")
        result = materialize(inner.where("id > 1"), "result", scoped=False)
    assert result.count() == 3 and [p.name.split("-")[0] for p in pathlib.Path(folder).iterdir()] == ["result"]
    with pytest.raises(ValueError), dropped_after(spark):
        materialize(spark.range(5), "inner")
        raise ValueError
    assert len(list(pathlib.Path(folder).iterdir())) == 1
