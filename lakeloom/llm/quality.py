"""Quality rules: statistics of whole texts, and a decision list learned from labels by sequential covering."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import let, materialize, table, words

#: Words of a window whose second appearance makes its words repeated.
WINDOW = 8
#: A document fails outright below so many words, or beyond so many hundredths of repeated words.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: About how many labelled rows the list is fitted on (a bounded sample by hash of the id).
FIT_ROWS = 20_000
#: Limits of the search: thresholds tried per statistic, conditions in a rule, rules in the list.
CUTS, CONDITIONS, RULES = 32, 3, 8
#: Share of the best gain from which a condition counts as about as good.
NEAR_BEST = 0.97
#: A rule stays only if it holds for so many rows that grew it, and if so large a share of the held-out rows is bad.
LEAST_ROWS, LEAST_PRECISION = 8, 0.9
FEATURES = ("f_words", "f_word_chars", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_shouts", "f_distinct", "f_digits")


def _repeated(ws: Column) -> Column:
    """Words that lie in a window found twice or more in the array ``ws``.

    Windows are hashed in place; only if two hashes agree are (hash, place) pairs sorted, the places of equal
    neighbours taken, and the lengths of their union added up. Linear but for that sort.
    """
    size = F.size(ws)
    hashes = F.when(size > WINDOW, F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda a, b: a["h"] == b["h"]
        twice = let(pairs, lambda s: F.filter(s, lambda e, i: F.coalesce(same(F.get(s, i - 1), e), F.lit(False)) | F.coalesce(same(F.get(s, i + 1), e), F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda e: e["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_s``: a struct of the statistics of its whole text. Built-in functions only, no shuffle.

    Null text counts as empty: every statistic is 0. Two projections, so that the words are split once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x09-\\x0D\\x20]"))

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
            _repeated(ws).alias("n_repeat_words"),
        )

    counts = F.struct(
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace(text, "[^0-9]+", "")).cast("long").alias("n_digits"),
    )
    return docs.withColumn("_w", let(words(F.col("text")), of)).withColumn("_c", counts)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")


def feature_columns(w: Column | None = None, c: Column | None = None) -> dict[str, Column]:
    """The statistics that rules compare with thresholds, as ratios that don't grow with the text; of columns ``_w`` and ``_c`` unless others are given."""
    w, c = F.col("_w") if w is None else w, F.col("_c") if c is None else c
    n, chars = w["n_words"], w["word_chars"]
    return {
        "f_words": n.cast("double"),
        "f_word_chars": _ratio(chars, n),
        "f_symbols": _ratio(c["n_symbols"], n),
        "f_dup_lines": _ratio(c["n_dup_lines"], n),
        "f_repeats": _ratio(w["n_repeat_words"], n),
        "f_upper": _ratio(c["n_upper"], chars),
        "f_shouts": _ratio(c["n_shouts"], n),
        "f_distinct": _ratio(w["n_distinct"], n),
        "f_digits": _ratio(c["n_digits"], chars),
    }


def base_failed(w: Column | None = None) -> Column:
    w = F.col("_w") if w is None else w
    n, repeated = w["n_words"], w["n_repeat_words"]
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def fit_decision_list(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, base: bool = True) -> list[list[tuple[str, str, float]]]:
    """Ordered rules, each a conjunction of (feature, ``<=`` or ``>``, threshold); a document that meets one is bad.

    Sequential covering on a sample of about ``rows`` labelled documents: a rule grows one condition at a time on two
    thirds of the rows, by the gain of Quinlan's FOIL; it is pruned to the beginning that does best on the others;
    rows that it covers are set aside and the next one grows. Spark takes the sample, its statistics and the cuts; the search itself
    sees a bounded table of small numbers (``rows`` documents x features) on the driver. Without labels, or without a class, the list is empty and nothing
    more than the base rules is rejected. Null labels and null ids take no part, and with ``base`` neither do rows that the base rules reject anyway.
    Of rows that share an id the smallest text speaks for it, so that ``rows`` bounds what is collected. ``RULES``, ``CONDITIONS`` and ``CUTS`` bound the list, not the rows it judges.
    """
    bad = (F.col("quality") == 0).cast("int")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(bad).alias("bad"))
    total = known.count()
    if not total:
        return []
    buckets = 1 << 20
    share = min(buckets, math.ceil(buckets * rows / total))
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(buckets)) < share)
    inputs = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded: about ``rows`` ids
    inputs = inputs.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("bad").alias("bad"))  # one row an id, however many there are
    # written before the filter on statistics: pushed below the join, it would compute them for all documents
    stats = with_statistics(materialize(inputs, "quality-sample", "zstd")).withColumn("failed", base_failed())
    grow = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(3)) < 2).alias("grow")
    fit = materialize(stats.select("bad", "failed", grow, *[c.alias(k) for k, c in feature_columns().items()]), "quality-fit")
    fit = fit.where("NOT failed") if base else fit
    cuts = fit.coalesce(1).agg(*[F.percentile_approx(f, [i / CUTS for i in range(1, CUTS)], 1000).alias(f) for f in FEATURES]).head()
    if cuts is None or cuts[FEATURES[0]] is None:
        return []
    at = {f: sorted({round(float(v), 6) for v in cuts[f]}) for f in FEATURES}
    at = {f: sorted({*vs, *[round((a + b) / 2, 6) for a, b in zip(vs, vs[1:], strict=False)]}) for f, vs in at.items()}
    place = {f: reduce(lambda a, b: a + b, [(F.col(f) > v).cast("int") for v in at[f]]) for f in FEATURES}
    rows = fit.select("bad", "grow", *[c.alias(f) for f, c in place.items()]).collect()  # the bounded sample: about FIT_ROWS rows of small numbers
    bad, grow = (np.asarray([r[c] for r in rows], dtype=bool) for c in ("bad", "grow"))
    bins = {f: np.asarray([r[f] for r in rows], dtype=np.int64) for f in FEATURES}

    def holds(rule: list[tuple[str, str, int]]) -> np.ndarray:
        met = np.ones(len(rows), dtype=bool)
        for f, op, i in rule:
            met &= bins[f] <= i if op == "<=" else bins[f] > i
        return met

    def grown(rest: np.ndarray) -> list[tuple[str, str, int]]:
        rule: list[tuple[str, str, int]] = []
        for _ in range(CONDITIONS):
            here = rest & grow & holds(rule)
            n0, p0 = int((here & ~bad).sum()), int((here & bad).sum())
            if not p0 or not n0:
                break
            tried = []
            for f in FEATURES:
                below = [np.cumsum(np.bincount(bins[f][here & which], minlength=len(at[f]) + 1)).tolist() for which in (~bad, bad)]
                for i in range(len(at[f])):
                    n1, p1 = below[0][i], below[1][i]
                    for op, (n, p) in (("<=", (n1, p1)), (">", (n0 - n1, p0 - p1))):
                        if p >= LEAST_ROWS:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            tried.append((gain, p + n, (f, op, i)))
            most = max((g for g, _, _ in tried), default=0.0)
            if most <= 1e-9:
                break
            # of conditions that are about as good, the one that rejects least, with the threshold farthest from the rest
            best = [(covered, -gain, -c[2] if c[1] == ">" else c[2], c) for gain, covered, c in tried if gain >= NEAR_BEST * most]
            rule.append(min(best)[3])
        return rule

    rules: list[list[tuple[str, str, int]]] = []
    rest = np.ones(len(rows), dtype=bool)
    for _ in range(RULES):
        rule = grown(rest)
        if not rule:
            break
        worth = []
        for k in range(len(rule)):
            met = rest & ~grow & holds(rule[: k + 1])
            n, p = int((met & ~bad).sum()), int((met & bad).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, n, p))
        _, k, n, p = max(worth)
        if not p or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule[: 1 - k])
        rest &= ~holds(rules[-1])
    return [[(f, op, at[f][i]) for f, op, i in rule] for rule in rules]


def verdict(rules: list[list[tuple[str, str, float]]], features: dict[str, Column] | None = None) -> Column:
    """The list as an ordered conditional expression: number of the first rule that holds, from 1; 0 if none does."""
    features = features or feature_columns()
    # bin i of a feature counts the cuts below it: "bin <= i" is "value <= cut i"
    test = lambda f, op, v: features[f] <= F.lit(v) if op == "<=" else features[f] > F.lit(v)
    out = None
    for k, rule in enumerate(rules, 1):
        cond = reduce(lambda a, b: a & b, [test(*c) for c in rule])
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, base: bool = True) -> DataFrame:
    """``docs`` (columns other than these) with ``_w``, ``_c`` (statistics), ``_base_failed``, ``_rule`` and ``_kept``, in one pass without a shuffle."""
    rules = fit_decision_list(docs, labels, rows, base)
    judged = with_statistics(docs).withColumn("_base_failed", base_failed()).withColumn("_rule", verdict(rules))
    return judged.withColumn("_kept", (~F.col("_base_failed") if base or not rules else F.lit(True)) & (F.col("_rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, base: bool = True) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned list rejects; columns stay, whatever their names.

    Without ``base`` the list alone decides, learned from all labelled rows: short or repetitive texts then go only as far as labels say that they
    are bad (the base rules decide where the labels teach no rule). Null and empty texts have no words and go with the base rules. Rows are judged one by one: repeated rows and rows without an id are judged alike.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rules = fit_decision_list(docs, labels, rows, base)
    with_base = base or not rules

    def good(s: Column) -> Column:
        met = verdict(rules, feature_columns(s["_w"], s["_c"])) == 0
        return ~base_failed(s["_w"]) & met if with_base else met

    # as one expression, so that a filter pushed to the scan computes the statistics once a row, however many conditions use them
    return with_statistics(docs.select("doc_id", "text", whole)).where(let(F.struct("_w", "_c"), good)).select("_doc.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: statistics and verdict for every document."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "_w.n_words", "_w.word_chars", "_c.n_symbols", "_c.n_dup_lines", "_w.n_repeat_words",
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))
