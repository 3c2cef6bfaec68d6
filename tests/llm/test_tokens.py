"""Token ids equal the library's; packing and coded files are exact round trips."""

import pathlib
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import binout, packing, tokens

ODD = ["a  b\n\n c\x1cd  ", "İ É é K x y ́z don't 12 34 <|endoftext|>q", "", "  ", "\n \n", " ", "a\xa0b   c", "x \n y\t z 5 %%% !!",
    "á é. it's I'll. x've... ", " lead", "Ünïcode, ß. ﬁ ² ½", "a\x00b", "e.g. https://a.b/c?d=1,2;(3)", "×÷é, naïve… —dash", None]


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("thereonand") for _ in range(rnd.randint(1, 9)))
    texts = [" ".join(word() + rnd.choice(["", "", ",", ".", "!", ".\n"]) for _ in range(rnd.choice([0, 3, 40, 400, 6000 if i % 20 == 0 else 60]))) for i in range(n)]
    return [(i, t) for i, t in enumerate(texts + ODD)] + [(3, texts[3]), (None, "no id")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 500)
    enc = tokens.PieceEncoder(tokens.public_path(name))
    texts = [t or "" for _, t in corpus(2)]
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, dtype=enc.kind).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_at_white_space_runs(name):
    enc = tokens.PieceEncoder(tokens.public_path(name))
    texts = ["a\n\nb", "a \n\nb", "a\n\n\n\nb", "\t\n\tb", "a\n\n5", "\n\n.b", "x\n\n", "\nb", "First paragraph.\n\nSecond one."]
    rnd = random.Random(4)
    texts += ["".join(rnd.choice("\n\n\r\t\v  aB5.,'é\u4e2d\x1c") for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype=enc.kind).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_whose_hashes_collide(name):
    """Thue-Morse words have equal polynomial hashes for every base: in one chunk, and against the cache."""
    enc = tokens.PieceEncoder(tokens.public_path(name))
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    for texts in ([f"x {one} y", f"x {two} y", f"{one} {two} {one}"], [two, f"q {two}", one]):
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, dtype=enc.kind).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_same_bytes():
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))).encode() for _ in range(400)]
    at = np.cumsum([0] + [len(p) for p in parts[:-1]])
    n = np.asarray([len(p) for p in parts])
    raw = tokens.padded(*parts)
    i, j = (np.asarray([rnd.randrange(400) for _ in range(20000)]) for _ in range(2))
    i, j = i[n[i] == n[j]], j[n[i] == n[j]]
    assert tokens.same_bytes(raw, at[i], raw, at[j], n[i]).tolist() == [parts[a] == parts[b] for a, b in zip(i, j, strict=True)]


def test_packing(spark):
    rows = [*corpus(), (90, "a very long text of many windows " * 20_000)]
    path = tokens.public_path("word_bpe_49k.json")
    enc = tokens.encoder(path).tokenizer
    out = packing.with_crc(packing.pack(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bin string"), path), path).toPandas()
    want = sorted(((-1 if d is None else d), np.asarray(enc.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()) for d, t in rows)
    got = {}
    for r in out.itertuples():
        assert r.length > 0 and r.start + r.length <= r.doc_tokens
        got.setdefault(-1 if r.doc_id != r.doc_id else int(r.doc_id), []).append(r)
    for d in {d for d, _ in want}:
        texts = [b for x, b in want if x == d]
        pieces = sorted(got[d], key=lambda r: (r.start, r.sequence_id))
        assert sum(r.length for r in pieces) == sum(len(b) // 4 for b in texts)
        for r in pieces:
            assert any(zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for b in texts)
    assert out.length.sum() == sum(len(b) // 4 for _, b in want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length.tolist())[:-1]] and s.length.sum() <= packing.WINDOW
    assert out.length.sum() >= 0.9 * packing.WINDOW * (out.sequence_id.nunique() - 2)


def test_packing_empty_table(spark):
    path = tokens.public_path("word_bpe_49k.json")
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_counts_never_exceed_documents():
    rnd = np.random.default_rng(3)
    combos = packing.combinations(16, 3)
    assert all(sum(c) == 16 for c in combos) and len(set(combos)) == len(combos)
    for hist in (rnd.integers(0, 50, 16), np.zeros(16, dtype=int), np.eye(16, dtype=int)[7] * 1001):
        counts = packing.solve_counts(hist, combos)
        used = sum(np.bincount(np.asarray(c) - 1, minlength=16) * k for c, k in zip(combos, counts, strict=True))
        assert (used <= hist).all() and (counts >= 0).all()
    assert counts[combos.index((8, 8))] == 500


@pytest.mark.parametrize("n", [0, 1, 63, 1000, 70_001])
def test_coder_round_trip_and_checkpoints(n, monkeypatch):
    monkeypatch.setattr(binout, "EVERY", 8)
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.01, n), 999).astype(np.uint32)
    coder = binout.Rans(binout.scaled_frequencies(np.bincount(ids, minlength=1000) if n else np.ones(1000, dtype=int)))
    lanes, words, states, where, marks = coder.encode(ids)
    assert coder.decode(n, lanes, words, states).tolist() == ids.tolist()
    for k, at in enumerate(where):
        part = coder.decode(n, lanes, words, marks[8 * lanes * k : 8 * lanes * (k + 1)], first_step=8 * (k + 1), at=at)
        assert part.tolist() == ids[8 * (k + 1) * lanes :].tolist()
    if n > 1000:
        assert len(words) < 2 * n


def test_token_files(spark, monkeypatch, folder):
    """Repeated rows, rows without an id, very long texts and extra columns; whole blocks, and ranges from checkpoints."""
    monkeypatch.setattr(binout, "BLOCK_IDS", 20_000)
    rows = [*corpus(5), (3, corpus(5)[3][1]), (None, "second without"), (70, "a very long text " * 150_000)]
    path = tokens.public_path("byte_bpe_50k.json")
    enc = tokens.encoder(path).tokenizer
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, at int").repartition(3)
    out = f"{folder}/ids"
    binout.write_blocks(df, path, out)
    monkeypatch.setattr(binout, "EVERY", 64)  # the files say what they were written with
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in binout.read_blocks(spark, out).collect())
    want = sorted((-1 if d is None else d, np.asarray(enc.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()) for d, t in rows)
    assert sorted((d, ids) for d, _, _, ids in got) == want
    start = 0
    for _, at, n, ids in sorted(got, key=lambda r: r[1]):
        assert at == start and n == len(ids) // 4
        start += n
    whole = b"".join(ids for _, _, _, ids in sorted(got, key=lambda r: r[1]))
    for first, last in ((0, start), (5, 6), (start - 400_000, start - 3), (20_000, 700_000)):
        pieces = sorted((r["start"], bytes(r["ids"])) for r in binout.read_range(spark, out, first, last).collect())
        assert pieces[0][0] == first and b"".join(x for _, x in pieces) == whole[4 * first : 4 * last]
    code = f"""if True:
        import sys, zlib
        from pyspark.sql import SparkSession
        sys.path.insert(0, {str(pathlib.Path(binout.__file__).parents[2])!r})
        from lakeloom.llm import binout
        s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        print("CRC", zlib.crc32(b"".join(bytes(r["ids"]) for r in binout.read_blocks(s, {out!r}).orderBy("start").collect())))"""
    other = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert f"CRC {zlib.crc32(whole)}" in other.stdout, other.stderr[-2000:]


def test_damaged_token_files_are_errors(spark, folder):
    out, df = f"{folder}/ids", spark.createDataFrame(corpus(7), "doc_id long, text string")
    binout.write_blocks(df, tokens.public_path("byte_bpe_50k.json"), out)
    blocks, head = spark.read.parquet(f"{out}/blocks"), spark.read.parquet(f"{out}/table")
    flip = F.concat(F.expr("substring(words, 1, 40)"), F.unhex(F.lit("ff")), F.expr("substring(words, 42)"))
    blocks.withColumn("words", flip).write.parquet(f"{folder}/bad/blocks")
    head.write.parquet(f"{folder}/bad/table")
    for read in (binout.read_blocks(spark, f"{folder}/bad"), binout.read_range(spark, f"{folder}/bad", 0, 1 << 40)):
        with pytest.raises(Exception, match="damaged"):
            read.collect()
    for name, change in (("old", {"version": F.lit(0)}), ("broken", {"crc32": F.col("crc32") + 1})):
        head.withColumns(change).write.parquet(f"{folder}/{name}/table")
        with pytest.raises(ValueError, match="not files|damaged"):
            binout.read_blocks(spark, f"{folder}/{name}")


def test_token_files_of_an_empty_table(spark, folder):
    binout.write_blocks(spark.createDataFrame([], "doc_id long, text string"), tokens.public_path("byte_bpe_50k.json"), f"{folder}/ids")
    assert binout.read_blocks(spark, f"{folder}/ids").count() == 0
