"""Personal data against plain regular expressions, bootstrapping on planted contexts, and recall of neighbours."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lakeloom.llm import neighbours, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_equal_regular_expressions():
    rnd = random.Random(6)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1@@..-+ 23_(%9é") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), repr(text)
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def spans_of(rows):
    return {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["found"]] for r in rows}


def test_two_generations_of_contexts(spark):
    """Seeds stand in one context; six unseen numbers there are found, induce a second context, and that finds a seventh."""
    numbers = [f"555-123-45{i:02d}" for i in range(6)]
    rows = [(i, f"word {i} here you may call me +1 (555) 555-{1000 + i} today for more") for i in range(12)]
    rows += [(100 + i, f"some other text, call me {n} today for more {i}") for i, n in enumerate(numbers)]
    rows += [(200 + i, f"the office line reads {n} before noon {i}") for i, n in enumerate(numbers)]
    rows += [(300, "the office line reads (020) 7946 0958 before noon"), (301, f"x{numbers[0]} {numbers[0]} elsewhere"), (302, "part 555-999-9999 was shipped")]
    rows += [(303, None), (304, ""), (305, "call me tomorrow 12 times"), (300, "the office line reads (020) 7946 0958 before noon"), (None, f"see {numbers[1]}")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, instance string")
    out = pii.extract(df).collect()
    found = spans_of(out)
    assert len(out) == len(rows)
    at = lambda doc, n: (dict(rows)[doc].index(n), dict(rows)[doc].index(n) + len(n), 3)
    assert all(found[100 + i] == [at(100 + i, n)] and found[200 + i] == [at(200 + i, n)] for i, n in enumerate(numbers))
    assert found[300] == [at(300, "(020) 7946 0958")]  # by a pattern that no seed stands in
    assert found[301] == [(14, 26, 3)] and found[None] == [(4, 16, 3)]  # found once, marked wherever it stands
    assert all(not found[i] for i in (*range(12), 302, 303, 304, 305))
    assert pii.extract(df.limit(0)).count() == 0


def plain_discover(places):
    """Bootstrapping in plain Python: {instance: kind} beyond the seeds."""
    edges = {}
    for p in places:
        for c in p["contexts"]:
            seed, fits = edges.get((c, p["instance"]), (-1, 0))
            edges[c, p["instance"]] = (max(seed, p["seed"]), max(fits, p["fits"]))
    by_context = {}
    for (c, i), (seed, fits) in edges.items():
        by_context.setdefault(c, []).append((i, seed, fits))
    by_context = {c: e for c, e in by_context.items() if len(e) > pii.SEEDS and any(s < 0 for _, s, _ in e)}
    seeds = {}
    for e in by_context.values():
        for i, s, _ in e:
            if s >= 0:
                seeds[i] = min(s, seeds.get(i, 99))
    known = {i: (k, 1.0) for i, k in seeds.items()}
    while True:
        left = {}
        for e in by_context.values():
            for k in range(5):
                mine = [known[i][1] for i, _, _ in e if i in known and known[i][0] == k]
                against = sum((i in known and known[i][0] != k) or (i not in known and not f >> k & 1) for i, _, f in e)
                if len(mine) >= pii.SEEDS and sum(mine) / (sum(mine) + against) >= pii.PATTERN_SCORE:
                    for i, s, f in e:
                        if s < 0 and f >> k & 1:
                            left[i, k] = left.get((i, k), 1.0) * max(1e-6, 1 - sum(mine) / (sum(mine) + against))
        best = {}
        for (i, k), x in left.items():
            if 1 - x >= pii.INSTANCE_SCORE and i not in known:
                best[i] = max(best.get(i, (-1, 0)), (1 - x, -k))
        if not best:
            return {i: k for i, (k, _) in known.items() if i not in seeds}
        known |= {i: (-k, x) for i, (x, k) in best.items()}


def test_discovery_equals_brute_force(spark):
    rnd = random.Random(9)
    numbers = [f"555-{i:03d}-{1000 + i}" for i in range(40)] + [f"+1 (555) 200-{1000 + i}" for i in range(25)] + [f"user{i}@host" for i in range(20)]
    numbers += [f"mail{i}@example.com" for i in range(15)] + [f"x{i}y" for i in range(20)] + [f"12-34-{i}" for i in range(10)]
    frames = [f"{a} {b} {{}} {c} {d}" for a, b, c, d in (rnd.sample(["call", "write", "see", "note", "line", "desk", "home", "at", "for"], 4) for _ in range(14))]
    rows = []
    for i in range(700):
        f = rnd.randrange(14)
        rows.append((i, frames[f].format(numbers[(f * 11 + rnd.randrange(22)) % len(numbers)])))
    places = [(p["start"], p["end"], p["seed"], p["fits"], p["instance"], p["contexts"]) for _, t in rows for p in pii.candidates(t, pii.base_spans(t))]
    df = spark.createDataFrame(places, "start long, end long, seed int, fits int, instance string, contexts array<string>")
    want = plain_discover([dict(zip(("start", "end", "seed", "fits", "instance", "contexts"), p, strict=True)) for p in places])
    assert {r["instance"]: r["kind"] for r in pii.discover(df).collect()} == want and want


def test_eight_generations_of_contexts(spark):
    """Each generation of numbers stands in its context and in the next one, which only they lead to."""
    generations, rows = 8, [(i, f"word {i} here you may call me +1 (555) 555-{1000 + i} today for more") for i in range(6)]
    for g in range(generations):
        for i in range(5):
            n = f"555-{g:03d}-45{i:02d}"
            here = f"you may call me {n} today for more" if g == 0 else f"the {'abcdefgh'[g]}desk reads {n} before {'abcdefgh'[g]}noon it says"
            rows.append((100 + 10 * g + i, here))
            rows.append((300 + 10 * g + i, f"the {'bcdefghi'[g]}desk reads {n} before {'bcdefghi'[g]}noon it says"))
    found = spans_of(pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(len(found[100 + 10 * g + i]) == len(found[300 + 10 * g + i]) == 1 for g in range(generations) for i in range(5))


def test_spans_of_one_text_are_parted_in_one_pass():
    n = 100_000
    spans = [{"start": i * 3 % (2 * n), "end": i * 3 % (2 * n) + 4, "kind": i % 4} for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([spans, [], [{"start": 5, "end": 6, "kind": 0}, {"start": 5, "end": 9, "kind": 1}]],
        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])))], ["_row", "all"])
    began = time.perf_counter()
    first, empty, last = next(pii._apart([batch])).column("all").to_pylist()
    assert time.perf_counter() - began < 5
    assert empty == [] and last == [{"start": 5, "end": 9, "kind": 1}]
    kept, end = [], -1
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
        if s["start"] >= end:
            kept.append(s)
            end = s["end"]
    assert first == kept


def test_patterns_with_strings_that_do_not_fit_find_nothing(spark):
    rows = [(i, f"he wrote down +1 (555) 555-{1000 + i} in all") for i in range(5)]
    rows += [(50 + i, f"he wrote down {i} in all") for i in range(9)] + [(90, "he wrote down 555-123-4567 in all")]
    found = spans_of(pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert not any(found.values())


def test_secrets_and_long_tokens(spark):
    keys = [f"{i:040x}" for i in range(1, 6)]
    rows = [(i, f'set token = "{k}" there') for i, k in enumerate(keys)] + [(10, 'set token = "Zm9vYmFyYmF6cXV4MTIzNDU2" there'), (11, "plain Zm9vYmFyYmF6cXV4MTIzNDU3 here")]
    long = "7" * 300_000
    rows += [(20, f"{long} {long}@{long} {'x' * 200_000}"), (21, "9 " * 100_000)]
    out = {r["doc_id"]: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(out[i]["secrets"]) for i in (*range(5), 10, 11)] == [1] * 6 + [0]
    assert rows[5][1][out[10]["secrets"][0]["start"] : out[10]["secrets"][0]["end"]] == "Zm9vYmFyYmF6cXV4MTIzNDU2"
    assert not out[20]["found"] and not out[21]["found"]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 400)
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((20, 32))
    v = centres[rnd.integers(0, 20, 1500)] + 0.6 * rnd.standard_normal((1500, 32))
    v[700:760] = v[0]
    rows = [(i, x.tolist(), "e") for i, x in enumerate(v)] + [(5000, None, "e"), (5001, [0.0] * 32, "e"), (5050, [float("nan")] + [1.0] * 31, "e"),
        (5100, [None] + [1.0] * 31, "e"), (5150, [float("inf")] * 32, "e"), (5200, [1.0, 2.0], "e"), (None, [1.0] * 32, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim string")
    ok = neighbours.usable(df, "vec_id", "embedding")
    got = {}
    for r in neighbours.nearest(ok, ok.where(F.col("vec_id") % 50 == 0), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 50):
        c = unit @ unit[q]
        c[q] = -9
        best = set(np.lexsort((np.arange(1500), -np.round(c, 12)))[:5].tolist())
        found = [got[q][r] for r in range(1, 6)]
        hit += len(best & {i for i, _ in found})
        assert all(abs(s - c[i]) < 1e-12 for i, s in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hit / 150 >= 0.9
    assert [got[0][r][0] for r in range(1, 6)] == [700, 701, 702, 703, 704]  # ties go to smaller ids
    assert 5200 not in got and not {5001, 5050, 5100, 5150} & set(got)
    big = spark.createDataFrame([(1, [1e300, 1e300]), (2, [2e300, 1e300]), (3, [1e-300, 1e-300]), (3, [1e-300, 1e-300]), (50, [1e-310, 2e-310])],
        "vec_id long, embedding array<double>")
    wide = neighbours.usable(big, "vec_id", "embedding")
    hits = [(r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(wide, wide.where("vec_id = 50"), 5).orderBy("rank").collect()]
    assert sorted(i for i, _ in hits[:3]) == [1, 3, 3] and hits[3][0] == 2 and abs(hits[0][1] - 3 / 10**0.5) < 1e-6
    few = ok.where("vec_id < 3")
    assert neighbours.nearest(few, few.where("vec_id = 0"), 5).count() == 2
    assert neighbours.nearest(ok.limit(0), ok.limit(0), 5).count() == 0
