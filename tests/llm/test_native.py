"""Native operators against brute force: mixing, quality rules, line dedup, URL filter, license scan."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import licenses, linededup, mixing, quality, urlfilter
from lakeloom.llm.common import distributed_rank, running_total

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- ranks and totals


def test_distributed_rank_and_total(spark):
    rows = [(g, v) for g in "aab" for v in range(50)] + [("c", 7)] * 30
    df = spark.createDataFrame(rows, "g string, v int")
    ranks = distributed_rank(df, ["g"], ["v"], "t").groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert {x["g"]: x["r"] for x in ranks} == {"a": list(range(100)), "b": list(range(50)), "c": list(range(30))}
    out = running_total(df.where("g = 'b'"), ["v"], "v", "t").collect()
    assert {r["v"]: r["start"] for r in out} == {v: sum(range(v)) for v in range(50)}
    assert distributed_rank(df.where("g = 'z'"), ["g"], ["v"], "t").count() == 0


# ---- mixing


def water_fill(sizes, weights, total):
    target = {s: 0.0 for s in sizes}
    open_, left = set(sizes), total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        over = 0.0
        share = {s: left * weights[s] / w for s in open_}
        for s in list(open_):
            target[s] += share[s]
            if target[s] > 2 * sizes[s]:
                over += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = over
    return target


def test_mixing(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), rnd.choice(["hot"] * 6 + ["b", "a", "Z", "é", None]), "x", 5) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rank string, w int")
    plan = [r.asDict() for r in mixing.mix_plan(df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()]
    again = [r.asDict() for r in mixing.mix_plan(df.repartition(7).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()]
    assert sorted((r["doc_id"], r["copies"]) for r in plan) == sorted((r["doc_id"], r["copies"]) for r in again)
    sizes = collections.Counter()
    for r in plan:
        assert r["size"] == len(WORD.findall(rows[r["doc_id"]][1])) and 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in order:
        mine = [r for r in plan if r["source"] == s]
        assert {round(r["target"], 6) for r in mine} == {round(want[s], 6)}
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - want[s]) <= max(600, 0.05 * want[s])


def test_mix_documents_emits_copies(spark):
    rows = [(i % 7, f"t {i} " * 9, "s") for i in range(40)] + [(1, None, None), (2, "same", "s"), (2, "same", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and out.count() > len(rows)
    assert max(collections.Counter((r["doc_id"], r["text"]) for r in out.collect()).values()) <= 4
    assert mixing.mix_documents(spark.createDataFrame([], df.schema)).count() == 0


def test_mixing_with_columns_that_have_no_hash(spark):
    rows = [(i, f"t {i} " * 9, "s", {"a": i}, [{"x": "y"}]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.map` map<string,int>, deep array<map<string,string>>")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and {r["a.map"]["a"] for r in out.collect()} <= set(range(20)) and out.count() >= 20


def test_notices_beyond_the_bound_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(licenses, "NOTICE_WORDS", 10)
    with pytest.raises(ValueError, match="broadcast"):
        licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), (("x", "w " * 11),))


@pytest.mark.parametrize("text", [None, "", " ", "a", " a", "a ", "\ta\n b\r\x0b\x0c", "a\xa0b c", "\n\n"])
def test_word_count(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mixing.word_count(F.col("t"))).head()[0] == len(WORD.findall(text or ""))


# ---- quality


def stats(text):
    w = WORD.findall(text)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark):
    rnd = random.Random(8)
    texts = [None, "", "\n \n", "a " * 8, "a " * 9, "é" * 40] + ["".join(rnd.choice(["a ", "b ", "#", "\n", "c d e f g h i j\n", " ", "|&"])
        for _ in range(rnd.randint(1, 120))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.with_statistics(df).select("doc_id", "_w.n_words", "_w.word_chars", "_c.n_symbols", "_c.n_dup_lines", "_w.n_repeat_words").collect()
    for r in got:
        assert tuple(r)[1:] == stats(texts[r["doc_id"]] or ""), repr(texts[r["doc_id"]])


def labelled(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(900):
        ws = [word() for _ in range(rnd.randint(40, 120))]
        bad = i % 3 == 0
        if bad:
            ws = [w + "$$" for w in ws] if i % 2 else [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws), "extra"))
        if i % 5:
            labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, bad string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_list_holds_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rules = quality.fit_decision_list(docs, labels)
    assert 1 <= len(rules) <= quality.RULES and all(1 <= len(r) <= quality.CONDITIONS for r in rules)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    held_out = [i for i in range(900) if i % 5 == 0]
    assert sum((i in kept) == (i % 3 != 0) for i in held_out) / len(held_out) > 0.95


def test_fit_is_bounded_by_labels_whatever_rows_share_an_id(spark, monkeypatch):
    docs, labels = labelled(spark)
    some = docs.where("doc_id IN (1, 3)").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n")
    fitted, own = [], quality.materialize

    def watched(df, label, *rest):
        out = own(df, label, *rest)
        fitted.extend([out.count()] if label == "quality-fit" else [])
        return out

    monkeypatch.setattr(quality, "materialize", watched)
    quality.fit_decision_list(some, labels, rows=10)
    assert fitted and fitted[0] <= 2
    monkeypatch.undo()
    assert quality.fit_decision_list(docs.unionByName(docs), labels) == quality.fit_decision_list(docs, labels)  # copies don't vote


def test_quality_of_odd_rows(spark):
    """Null and empty texts fail, a very long text is read as a whole, repeated rows and rows without an id are judged like others."""
    _, labels = labelled(spark)
    good = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"x{i}" for i in range(150_000))
    texts = [(None, None), (1, ""), (2, good), (2, good), (None, good), (3, long), (4, f"{long} {long}"), (5, "few words")]
    df = spark.createDataFrame([(d, t, 1, "c", True) for d, t in texts], "doc_id long, text string, _w int, _c string, _kept boolean")
    kept = quality.keep_good(df, labels.limit(0))
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, len(r["text"]), r["_w"]) for r in kept.collect()) == [(0, len(good), 1), (2, len(good), 1), (2, len(good), 1), (3, len(long), 1)]


def test_quality_without_labels(spark):
    docs, labels = labelled(spark)
    assert quality.fit_decision_list(docs, labels.limit(0)) == []
    assert quality.fit_decision_list(docs.limit(0), labels) == []
    assert quality.keep_good(docs, labels.where("quality = 1")).count() == 900
    assert quality.keep_good(docs.limit(0), labels).columns == docs.columns


# ---- line dedup


def without_later_copies(rows, least):
    seqs = {i: [(k, x, len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for i, t in rows}
    first, gone = {}, {i: set() for i in seqs}
    for run in (False, True):
        for i in sorted(seqs):
            s = seqs[i]
            for a in range(len(s)):
                n = 0
                for b in range(a, len(s)):
                    n += s[b][2]
                    if n >= least:
                        key = tuple(x[1] for x in s[a : b + 1])
                        if not run:
                            first.setdefault(key, (i, a))
                        elif first[key] < (i, a):
                            gone[i] |= {x[0] for x in s[a : b + 1]}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("least", [1, 6, 50])
def test_line_dedup(spark, least):
    rnd = random.Random(least)
    pool = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, max(2, least // 2)))) for _ in range(12)]
    rows = [(i, "\n".join(rnd.choice([*pool, "", " ", f"own {i} {rnd.random()}"]) for _ in range(rnd.randint(0, 30)))) for i in range(40)]
    block = "\n".join(pool[:6])
    rows += [(50, block), (51, block), (52, "x\n" + block + "\ny"), (60, None), (61, ""), (62, "\n".join(["same line here"] * 40))]
    again = [r for r in rows if r[0] % 3 == 0]  # repeated rows change nothing
    df = spark.createDataFrame([(*r, 0, "z", 1, "q") for r in rows + again + again], "doc_id long, text string, n_chars long, island string, gone int, _k1 string")
    out = linededup.drop_repeated_lines(df, least)
    assert out.columns == df.columns and out.count() == df.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()} == without_later_copies(rows, least)


def test_line_dedup_with_hot_and_long(spark, monkeypatch):
    """One line and one passage in most documents, all keys above the limit of broadcast, and a very long text."""
    monkeypatch.setattr(linededup, "HOT", 20)
    rnd = random.Random(3)
    hot, passage = "every document has this line", "\n".join(f"w{i} is line {i} of a passage with ten words" for i in range(7))
    rows = [(i, "\n".join([hot, *[f"own {rnd.random()}" for _ in range(3)], *([passage] if i % 3 else []), hot])) for i in range(200)]
    rows.append((200, "\n".join(f"l {i % 5000} of a very long text that repeats" for i in range(12000))))
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == "\n".join(f"l {i} of a very long text that repeats" for i in range(5000))
    assert got[1] == rows[1][1] and all(got[i] == rows[i][1].replace(f"\n{passage}\n{hot}", "") for i in range(2, 200))


def test_line_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert linededup.drop_repeated_lines(spark.createDataFrame([], schema)).count() == 0
    line = "w " * 60
    twice = spark.createDataFrame([(1, line), (1, line), (1, "other\n" + line), (None, line)], schema)
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in linededup.drop_repeated_lines(twice).collect())
    assert got.count((0, line)) == 1 and len(got) == 4  # the row without an id comes first in the corpus


def test_line_dedup_of_repeated_rows(spark):
    text, other = ("\n".join(f"{w} line {i} of a passage of ten short ones" for i in range(10)) for w in ("first", "second"))
    rows = [(1, text), (1, text), (2, text), (3, "own\n" + text), (None, other), (None, other), (4, other)]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, ""), (0, other), (1, text), (1, text), (2, ""), (3, "own"), (4, "")]


# ---- URL filter


def test_urls(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "ftp://b.net/es/1", "http://b.net/ES/1", "http://net/fr/", "no scheme",
        None, "", "http://", "http://x.org", "http://x.org/a/index.html", "http://www.x.org/a#z", "a://b://c/d?e", "http://notexample.com/en/",
        "http://com", "x://É.org/\n/y"]
    listed = spark.createDataFrame([("x.org/a",), ("x.org/a",), (None,), ("q.org",)], "canonical string")
    df = spark.createDataFrame([(i, u, "zz", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, _m int")
    got = {urls[r["page_id"]]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df, listed).collect()}
    assert got == {
        "http://A.Example.com/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com",
            "/en/", "www.example.com/en/", "allow"), "ftp://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"),
        "http://b.net/ES/1": ("b.net", "/ES/1", None, "allow"), "http://net/fr/": ("net", "/fr/", "net/fr/", "block"), "no scheme": ("", "", None,
            "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "http://x.org": ("x.org", "", None, "allow"), "http://x.org/a/index.html": ("x.org", "/a/index.html", None, "block"),
            "http://www.x.org/a#z": ("www.x.org", "/a", None, "block"), "a://b://c/d?e": ("b:", "//c/d", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://com": ("com", "", None, "allow"), "x://É.org/\n/y": ("É.org", "/\n/y", None, "allow"),
    }


def test_urls_of_other_tables(spark):
    """Columns by the names of the result are replaced, others stay; empty tables; a list made from the html of any spelling of a URL."""
    schema = "page_id long, url string, html string, host string, _page int, rule int"
    junk = "### *** %%% $$$ " * 3
    rows = [(1, "http://www.x.org/a/", junk, "h", 7, 1), (2, "https://x.org/a?b=1", "fine", "h", 8, 1), (3, "http://x.org/b", "fine ### ###", "h", 9,
        1), (4, None, junk, "h", 1, 1), (5, "nothing", None, "h", 1, 1)]
    pages = spark.createDataFrame(rows, schema)
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"], r["_page"]) for r in urlfilter.judge_urls(pages, urlfilter.listed_by_content(pages)).collect()}
    assert got == {1: ("www.x.org", None, "block", 7), 2: ("x.org", None, "block", 8), 3: ("x.org", None, "allow", 9), 4: ("", None, "allow", 1), 5: ("", None, "allow", 1)}
    none = pages.limit(0)
    assert urlfilter.judge_urls(none, urlfilter.listed_by_content(none)).count() == 0


def test_bloom_has_no_false_negatives(spark, monkeypatch):
    listed = spark.range(3000).select(F.concat(F.lit("h.org/"), "id").alias("canonical"))
    urls = spark.range(9000).select(F.concat(F.lit("h.org/"), "id").alias("canonical"))
    for limit in (urlfilter.BROADCAST_BYTES, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", limit)
        assert urlfilter.match_listed(urls, listed).where("listed").count() == 3000
    assert urlfilter.match_listed(urls, listed.limit(0)).where("listed").count() == 0


# ---- license scan


def test_licenses(spark):
    texts = {
        1: "Released under the MIT License.", 2: "MIT-License, Apache  License; apache license", 3: None, 4: "", 5: "permit license",
            6: "GNU General\nPublic LICENSE v3", 7: "cc by and CC-BY",
        8: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            
        9: "Licensed under CC BY-NC 4.0.", 10: "the license of the public " * 30,
            11: "redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met",
            
        12: "gnu general publiK license", 13: "İ mit license K",
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, template int")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    places = {k: sorted((b["at"], b["label"]) for b in r["base"]) for k, r in got.items()}
    assert places == {1: [(3, "mit")], 2: [(0, "mit"), (2, "apache"), (4, "apache")], 3: [], 4: [], 5: [], 6: [(0, "gpl")], 7: [(0, "cc-by"), (3,
        "cc-by")], 8: [], 9: [(2, "cc-by")], 10: [], 11: [], 12: [], 13: [(1, "mit")]}
    found = {k: sorted(r["found"] or []) for k, r in got.items()}
    assert found[8] == ["mit"] and found[11] == ["bsd"] and "cc-by-nc" in found[9] and found[10] == [] and found[1] == ["mit"]
    assert got[13]["n_words"] == 4 and licenses.scan(df.limit(0)).count() == 0


def test_licenses_of_long_repeated_and_scattered_texts(spark):
    notice = licenses.TEMPLATES[2][1]
    ws = notice.split(" ")
    scattered = " ".join(" ".join(ws[i : i + 3]) + " filler" * 40 for i in range(0, len(ws) - 2, 3))
    rows = [(1, "word " * 200_000 + notice), (2, "MIT license"), (2, "MIT license"), (None, "apache license"), (3, scattered)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, len(r["base"]), sorted(r["found"] or [])) for r in licenses.scan(df).collect())
    assert got == [(0, 1, []), (1, 0, ["mit"]), (2, 1, []), (2, 1, []), (3, 0, [])]
    spans = [r["spans"] for r in licenses.scan(df).collect() if r["doc_id"] == 1][0]
    assert (spans[0]["first_word"], spans[0]["last_word"]) == (200_000, 200_000 + len(ws) - 1)
