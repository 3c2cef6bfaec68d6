"""Personal data: exact base patterns, and bootstrapped contextual extraction of identifiers that these miss."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize, ship_package, table

#: Kinds in the order in which spans of one start are listed; the last one is the method's own and has columns of its own.
KINDS, SECRET = ("email", "ip", "card", "phone"), 4
#: Least pattern and instance scores; different known identifiers that a pattern needs.
PATTERN_SCORE, INSTANCE_SCORE, SEEDS = 0.8, 0.8, 3
#: Characters from which a word or identifier stands in the graph by its sha256.
KEY = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run matches from its first digit or not at all, so later starts in it needn't be tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKS = re.compile(r"[0-9@]+")
_BLANK = re.compile(r"[ \t-\r]")
#: Numbers in groups with single blanks between them, as telephone and card numbers are written.
_GROUPS = re.compile(r"(?<![0-9().+/-])[+(]{0,2}[0-9][0-9().+/-]*+(?:\x20\(?[0-9][0-9().+/-]*+)+")
_PUNCTUATION = ".,;:!?\"'[]<>|#$%&*=`{}"
#: Weak form of each kind: what may be such an identifier if its contexts say so. The last one is a key of random letters and digits.
_WEAK = (
    re.compile(r"[^\s@]+@[^\s@]+"),
    re.compile(r"[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}"),
    re.compile(r"[0-9](?:[\x20.-]?[0-9]){11,18}"),
    re.compile(r"\+?\(?[0-9](?:[().\x20/+-]{0,3}[0-9]){6,14}\)?"),
    re.compile(r"(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])[A-Za-z0-9_/+-]{20,}"),
)
#: Seeds of the last kind: long hexadecimal keys.
_KEY = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ sign, so that long runs cost no more than their length."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all base matches, by start and then kind. Places are code points; null text has none."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), 1) for m in _ip_matches(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _ip_matches(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m


def _near(text: str, at: int, n: int, step: int) -> list[str]:
    """Up to ``n`` whole words before (``step`` -1) or behind (1) a place, in their order, however long they are."""
    width = 64
    while True:
        lo, hi = (max(0, at - width), at) if step < 0 else (at, min(len(text), at + width))
        found = text[lo:hi].split()
        if len(found) > n or (lo == 0 if step < 0 else hi == len(text)):
            return found[-n:] if step < 0 else found[:n]
        width *= 4


def _key(s: str) -> str:
    return s if len(s) < KEY else "sha256:" + hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def _word(raw: str) -> str:
    return _key(re.sub("[0-9]+", "0", raw.strip(_PUNCTUATION + "()").lower()))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical contexts of a place: two words before, the words around, two words behind, and a word before that ends in a colon or equals sign."""
    before, after = _near(text, start, 5, -1), _near(text, end, 5, 1)
    b, a = [w for w in map(_word, before) if w][-2:], [w for w in map(_word, after) if w][:2]
    out = []
    if len(b) == 2:
        out.append(f"L {b[0]} {b[1]}")
    if b and a:
        out.append(f"B {b[-1]} _ {a[0]}")
    if len(a) == 2:
        out.append(f"R {a[0]} {a[1]}")
    marks = re.search(r"[:=][\s\"'`]*$", " ".join(before))
    if b and marks:
        out.append(f"P {b[-1]}")
    return out


def fits(token: str) -> int:
    """The kinds whose weak form a token has, as bits."""
    digits = sum(c.isdigit() for c in token)
    limits = ((0, 1 << 62), (0, 1 << 62), (12, 19), (7, 15), (0, 1 << 62))
    return sum(1 << k for k, (weak, (lo, hi)) in enumerate(zip(_WEAK, limits, strict=True)) if lo <= digits <= hi and weak.fullmatch(token))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Places of the pattern-instance graph: base spans and keys (seeds of their kind), and all other tokens with a digit or @, of any length;
    also groups of numbers with blanks. A token without a weak form is a place too: it speaks against the patterns that it stands in."""
    place = lambda a, b, seed, bits: {"start": a, "end": b, "seed": seed, "fits": bits, "instance": _key(text[a:b]), "contexts": contexts(text, a, b)}
    out = [place(a, b, k, 1 << k) for a, b, k in spans]
    taken, at_span = sorted((a, b) for a, b, _ in spans), 0

    def free(a: int, b: int) -> bool:
        nonlocal at_span
        while at_span < len(taken) and taken[at_span][1] <= a:
            at_span += 1
        return not any(x < b and a < y for x, y in taken[at_span : at_span + 4])

    for m in _GROUPS.finditer(text):
        a, b = m.start(), m.start() + len(m[0].rstrip(".,/+-("))
        bits = fits(text[a:b])
        if bits and free(a, b):
            out.append(place(a, b, -1, bits))
    done = at_span = 0
    for m in _MARKS.finditer(text):
        at = m.start()
        if at < done:
            continue
        a = max(done - 1, *(text.rfind(c, done, at) for c in " \n\t\r\x0b\x0c")) + 1
        blank = _BLANK.search(text, at)
        b = done = blank.start() if blank else len(text)
        token = text[a:b]
        a += len(token) - len(token.lstrip(_PUNCTUATION))
        token = token.strip(_PUNCTUATION)
        b = a + len(token)
        if token and free(a, b):
            secret = _KEY.fullmatch(token) is not None
            out.append(place(a, b, SECRET if secret else -1, 1 << SECRET if secret else fits(token)))
    return out


_SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"
_PLACE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.int32()), ("fits", pa.int32()), ("instance", pa.string()), ("contexts", pa.list_(pa.string()))])
_PLACES = "array<struct<start:bigint,end:bigint,seed:int,fits:int,instance:string,contexts:array<string>>>"


def _scan(batches):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    for batch in batches:
        base, places, shas = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            marked = _MARKS.search(text)
            found = base_spans(text) if marked else []
            base.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            places.append(candidates(text, found) if marked else [])
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found).encode()).hexdigest())
        cols = [batch.column("_row"), batch.column("doc_id"), pa.array(base, spans_type), pa.array(shas), pa.array(places, pa.list_(_PLACE))]
        yield pa.RecordBatch.from_arrays(cols, ["_row", "doc_id", "base", "base_sha256", "places"])


def discover(places: DataFrame) -> DataFrame:
    """Identifiers (``instance``, ``kind``, ``score``) that bootstrapping finds beyond the seeds, which have score 1.

    The graph links contexts with the different strings seen in them, each once however often it stands, so that copied passages don't
    vote. In every round a context is scored for each kind: the scores of its known identifiers of that kind against these and what speaks
    against it (strings that haven't the kind's weak form, or are known to be of another kind); strings that may be of the kind and aren't known
    yet say nothing. With enough known ones it is a pattern, and the strings in it that fit get the score 1 minus the product
    of what their patterns leave open. What reaches ``INSTANCE_SCORE`` is known from the next round on, with the kind and score that it was
    found with, so that found identifiers induce patterns of their own; it ends when a round adds nothing, after however many. Contexts with too few strings to find anything are left out
    beforehand. Joins are shuffled: nothing that grows with the corpus is broadcast.
    """
    edges = places.select(F.explode("contexts").alias("context"), "instance", "seed", "fits").groupBy("context",
        "instance").agg(F.max("seed").alias("seed"), F.max("fits").alias("fits"))
    wide = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seed") < 0).alias("open")).where(f"n > {SEEDS} AND open > 0").select("context")
    edges = materialize(edges.join(wide.hint("merge"), "context", "left_semi"), "pii-graph")
    seeds = edges.where("seed >= 0").groupBy("instance").agg(F.min("seed").alias("kind"), F.lit(1.0).alias("score"))
    known = materialize(seeds, "pii-known")
    kinds = range(len(KINDS) + 1)
    while True:
        met = edges.join(known.hint("merge"), "instance", "left")
        mine = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
        may = lambda k: F.col("fits").bitwiseAND(1 << k) != 0
        against = lambda k: ~mine(k) & (F.col("kind").isNotNull() | ~may(k))
        sums = [x for k in kinds for x in (F.sum(F.when(mine(k), F.col("score"))).alias(f"for{k}"), F.count_if(mine(k)).alias(f"n{k}"),
            F.count_if(against(k)).alias(f"against{k}"))]
        scored = met.groupBy("context").agg(*sums)
        each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("n"), (F.col(f"for{k}") / (F.col(f"for{k}") + F.col(f"against{k}"))).alias("p")) for k in kinds])
        good = scored.select("context", F.explode(each).alias("e")).select("context", "e.*").where((F.col("n") >= SEEDS) & (F.col("p") >= PATTERN_SCORE))
        left = F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))
        seen = edges.where("seed < 0").join(good.select("context", "kind", "p").hint("merge"), "context").where(F.call_function("shiftright", "fits",
            F.col("kind")).bitwiseAND(1) != 0)
        best = seen.groupBy("instance", "kind").agg((1 - left).alias("score")).where(F.col("score") >= INSTANCE_SCORE)
        best = best.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("b")).select("instance",
            (-F.col("b.minus")).alias("kind"), F.col("b.score").alias("score"))
        new = materialize(best.join(known.select("instance").hint("merge"), "instance", "left_anti"), "pii-new")
        if new.isEmpty():
            break
        known = materialize(known.unionByName(new), "pii-known")
    return known.join(seeds.select("instance").hint("merge"), "instance", "left_anti")


def _apart(batches):
    """Spans of each row (``all``) that don't overlap, of any number: the first one stays, of one start the longest. Sorted once, then one pass."""
    for batch in batches:
        spans = batch.column("all")
        row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(spans)))
        start, end, kind = (np.asarray(pc.struct_field(spans.flatten(), c)) for c in ("start", "end", "kind"))
        order = np.lexsort((kind, -end, start, row))
        keep, last_row, last = [], -1, -1
        for i, r, a, b in zip(order.tolist(), row[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
            if r != last_row or a >= last:
                keep.append(i)
                last_row, last = r, b
        kept = pa.StructArray.from_arrays([pa.array(start[keep], pa.int64()), pa.array(end[keep], pa.int64()), pa.array(kind[keep], pa.int32())], ["start", "end", "kind"])
        sizes = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))])
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), kept)], ["_row", "all"])


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base``, ``found`` and ``secrets`` (arrays of start, end, kind) and ``base_sha256`` for every row of ``docs``.

    One pass reads whole texts for base spans and places of the graph. What bootstrapping finds once is marked wherever
    it stands outside base spans. ``secrets`` are keys: long hexadecimal ones are that kind's seeds, others are found. Null and empty texts have nothing; rows that
    repeat get equal answers; columns other than ``doc_id`` and ``text`` don't matter.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialize(rows.mapInArrow(_scan, f"_row bigint, doc_id bigint, base {_SPANS}, base_sha256 string, places {_PLACES}"), "pii-scan")
    places = seen.where(F.size("places") > 0).select("_row", F.explode("places").alias("p")).select("_row", "p.*")
    marked = places.where("seed < 0").join(discover(places).hint("merge"), "instance").where(F.call_function("shiftright", "fits", F.col("kind")).bitwiseAND(1) != 0)
    keys = places.where(F.col("seed") == SECRET).select("_row", "start", "end", F.col("seed").alias("kind"))
    found = marked.select("_row", "start", "end", "kind").unionByName(keys).groupBy("_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("all"))
    found = found.mapInArrow(_apart, f"_row bigint, all {_SPANS}")
    out = seen.drop("places").join(found.hint("merge"), "_row", "left").withColumn("all", F.coalesce("all", F.array().cast(_SPANS)))
    out = out.withColumn("found", F.filter("all", lambda s: s["kind"] != SECRET)).withColumn("secrets", F.filter("all", lambda s: s["kind"] == SECRET))
    return out.drop("_row", "all")


def _listed(spans: Column | str) -> Column:
    """``kind:start:end`` of each, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: number of base spans of each kind, their digest, and all spans of every document; beside them the secrets,
    and ``n_spans``, the number of all that was found."""
    found = extract(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    n_secret = F.size("secrets").cast("long")
    more = [n_secret.alias("n_secret"), _listed("secrets").alias("secret_spans"), (F.size("base") + F.size("found") + n_secret).alias("n_spans")]
    return found.select("doc_id", *counts, "base_sha256", _listed(F.concat("base", "found")).alias("spans"), *more)


def _of_kind(i: int):
    return lambda s: s["kind"] == i
