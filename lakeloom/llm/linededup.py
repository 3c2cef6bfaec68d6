"""Line dedup: prefix doubling over line-ID sequences, and deletion of the later copies of repeated runs.

Doubling names every 2^k lines of a document as a suffix array's construction does. What the deletion asks of the array are
its LCP intervals (which places share their first m lines), and these are the places with equal names: so the names are not
put in order and no array of sorted suffixes is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import let, materialize, table, unused, word_count

#: A run of lines counts as a repeated passage from so many words.
MIN_WORDS = 50
#: A key with more than this share of all rows is joined by broadcast: there are at most ``HOT`` such keys.
HOT = 65_536


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns (their names come with it): the id of a document, and a hash of its text where ids repeat.

    Rows that agree in both are one document. A row without an id is a document of its own, before all others; such
    rows are numbered and written, so that both reads of them see one number.
    """
    k1, k2 = unused(docs.columns, "_k1", "_k2")
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    id = F.col("doc_id").cast("long")
    without = materialize(docs.where(id.isNull()).withColumn(k1, F.monotonically_increasing_id() - (1 << 62)), "no-id")
    return docs.where(id.isNotNull()).withColumn(k1, id).unionByName(without).withColumn(k2, text), k1, k2


def line_sequences(docs: DataFrame, k1: str = "_k1", k2: str = "_k2") -> DataFrame:
    """One row per line that has a word, of documents with their key: document key, ``at`` (number of the line), ``idx`` (among lines with words),
    ``ha`` and ``hb`` (128 bits of hash of the exact line) and ``n`` (its words)."""
    line = lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("ha"), F.xxhash64(F.lit(7), x).alias("hb"), word_count(x).alias("n"))
    full = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), line), lambda e: e["n"] > 0)
    rows = docs.select(F.col(k1).alias("_k1"), F.col(k2).alias("_k2"), F.posexplode(full).alias("idx", "e"))
    return rows.select("_k1", "_k2", "idx", "e.at", "e.ha", "e.hb", "e.n")


def _met(rows: DataFrame, names: DataFrame, keys: list[str], total: int, how: str) -> DataFrame:
    """``rows`` joined with ``names`` (unique by ``keys``, with their number of rows ``_c``), whatever a key's share of the rows.

    Keys with more than 1 in ``HOT`` rows are at most ``HOT`` and broadcast; rows that have one are spread by their place in the shuffle
    for the others, so that no key brings more than that share to one task.
    """
    value = [c for c in names.columns if c not in (*keys, "_c")]
    hot = F.broadcast(names.where(F.col("_c") > total // HOT).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in value], F.lit(True).alias("_hot")))
    cold = names.where(F.col("_c") <= total // HOT).select(*[F.col(c).alias(f"_cold_{c}") for c in keys + value], F.lit(False).alias("_not_hot"))
    marked = rows.join(hot, keys, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    spread = [F.when(F.col("_hot"), F.xxhash64("_k1", "_k2", "idx")).otherwise(F.col(c)).alias(f"_cold_{c}") for c in keys]
    marked = marked.select("*", *spread).withColumnRenamed("_hot", "_not_hot")
    out = marked.join(cold, ["_not_hot", *[f"_cold_{c}" for c in keys]], "left")
    found = [F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in value]
    out = out.select(*rows.columns, *found)
    return out if how == "left" else out.where(F.col(value[0]).isNotNull())


def _repeated_only(lines: DataFrame) -> DataFrame:
    """Lines that appear twice or more, with ``r0``: the line's name, which is the number ``gid`` of one of its places."""
    names = lines.groupBy("ha", "hb").agg(F.count(F.lit(1)).alias("_c"), F.min("gid").alias("r0")).where("_c > 1")
    return _met(lines, materialize(names, "line-names"), ["ha", "hb"], lines.count(), "inner").drop("ha", "hb")


def _islands(lines: DataFrame, min_words: int) -> DataFrame:
    """``lines`` in stretches of consecutive repeated lines; stretches below ``min_words`` can hold no passage and go.

    The windows work on one document at a time. A line that stands again at its place is of a repeated row and goes.
    """
    doc = Window.partitionBy("_k1", "_k2").orderBy("idx")
    place = F.dense_rank().over(doc)
    again = F.coalesce(F.lag("idx").over(doc) == F.col("idx"), F.lit(False))
    once = lines.withColumn("_again", again).withColumn("island", F.col("idx") - place).where(~F.col("_again")).drop("_again")
    return once.withColumn("_sum", F.sum("n").over(Window.partitionBy("_k1", "_k2", "island"))).where(F.col("_sum") >= min_words).drop("_sum")


def prefix_names(lines: DataFrame, levels: int) -> DataFrame:
    """``lines`` with ``r1`` .. ``r<levels>``: a name for the 2^k lines from each place, equal where these lines are.

    Prefix doubling: 2^(k+1) lines are named by the pair of names of their halves; the second half's comes from the
    same document, by a window. Pairs are counted with map-side combine and named by the least ``gid`` that they begin at, so
    that names don't depend on the order of rows; a pair seen once has no name (null), and neither has what is longer.
    """
    doc = Window.partitionBy("_k1", "_k2").orderBy("idx")
    total = lines.count()
    for k in range(levels):
        step, old, new = 1 << k, f"r{k}", f"r{k + 1}"
        paired = lines.withColumn("_next", F.max(old).over(doc.rangeBetween(step, step)))
        named = paired.where(F.col(old).isNotNull() & F.col("_next").isNotNull()).groupBy(old, "_next").agg(F.count(F.lit(1)).alias("_c"), F.min("gid").alias(new)).where("_c > 1")
        lines = materialize(_met(paired, materialize(named, f"names-{k + 1}"), [old, "_next"], total, "left").drop("_next"), f"prefixes-{k + 1}")
    return lines


def _seeds(ranked: DataFrame, levels: int, min_words: int) -> DataFrame:
    """The shortest runs with ``min_words`` words that begin, or end, at each line: every longer run is their union.

    Each seed has its class: its length in lines, the name of its first 2^k and of its last 2^k lines (which overlap),
    that is its LCP interval. Works in arrays of one stretch of one document.
    """
    ranks = [f"r{k}" for k in range(levels + 1)]
    rows = ranked.groupBy("_k1", "_k2", "island").agg(F.sort_array(F.collect_list(F.struct("idx", "at", "n", *ranks))).alias("s"))

    def runs(s: Column) -> Column:
        size = F.size(s)

        def forward(i: Column) -> Column:
            last = F.least(size - i, F.lit(min_words))
            step = lambda a, e: F.struct((a["w"] + e["n"]).alias("w"), (a["m"] + F.when(a["w"] < min_words, 1).otherwise(0)).alias("m"))
            got = F.aggregate(F.slice(s, i + 1, last), F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("m")), step)
            return let(got, lambda g: F.when(g["w"] >= min_words, F.struct(i.alias("i"), g["m"].alias("m"))))

        def backward(e: Column) -> Column:
            first = F.greatest(e + 1 - min_words, F.lit(0))
            step = lambda a, x: F.struct((a["w"] + x["n"]).alias("w"), (a["m"] + F.when(a["w"] < min_words, 1).otherwise(0)).alias("m"))
            got = F.aggregate(F.reverse(F.slice(s, first + 1, e + 1 - first)), F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("m")), step)
            return let(got, lambda g: F.when(g["w"] >= min_words, F.struct((e + 1 - g["m"]).alias("i"), g["m"].alias("m"))))

        at = F.sequence(F.lit(0), size - 1)
        return F.array_distinct(F.filter(F.concat(F.transform(at, forward), F.transform(at, backward)), lambda x: x.isNotNull()))

    def classed(s: Column) -> Column:
        def of(x: Column) -> Column:
            i, m = x["i"], x["m"]
            first = lambda k: (F.get(s, i)[f"r{k}"], F.get(s, i + m - (1 << k))[f"r{k}"])
            level = None
            for k in range(levels + 1):
                ra, rb = first(k)
                value = F.struct(m.alias("m"), ra.alias("ra"), rb.alias("rb"), F.get(s, i)["idx"].alias("idx"), F.transform(F.slice(s, i + 1, m), lambda e: e["at"]).alias("ats"))
                cond = (m >= (1 << k)) & (m < (2 << k))
                level = F.when(cond, value) if level is None else level.when(cond, value)
            return level

        return F.filter(F.transform(runs(s), of), lambda x: x["ra"].isNotNull() & x["rb"].isNotNull())

    rows = rows.select("_k1", "_k2", F.explode(let(F.col("s"), classed)).alias("x"))
    return rows.select("_k1", "_k2", "x.m", "x.ra", "x.rb", "x.idx", "x.ats")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, k1: str = "_k1", k2: str = "_k2") -> DataFrame:
    """Lines to delete from documents with their key: document key (``_k1``, ``_k2``) and ``gone``, the sorted numbers of its lines that lie in a later copy.

    A line goes if it lies in a run of lines with at least ``min_words`` words that also stands, line for line, earlier
    in the corpus (by doc_id, then place). Lines without words are no part of a run. Self-overlapping runs count.
    Texts are split once; the lines are written with a number each.
    """
    levels = max(0, min_words.bit_length() - 1)  # a seed has at most min_words lines: 2^levels <= min_words
    all_lines = materialize(line_sequences(docs, k1, k2).withColumn("gid", F.monotonically_increasing_id()), "all-lines")
    lines = materialize(_islands(_repeated_only(all_lines), min_words), "lines")
    seeds = materialize(_seeds(prefix_names(lines, levels), levels, min_words), "seeds")
    place = F.struct("_k1", "_k2", "idx")
    first = seeds.groupBy("m", "ra", "rb").agg(F.count(F.lit(1)).alias("_c"), F.min(place).alias("first")).where("_c > 1")
    later = _met(seeds, materialize(first, "first-places"), ["m", "ra", "rb"], seeds.count(), "inner").where(place > F.col("first"))
    return later.groupBy("_k1", "_k2").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("gone"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, count: bool = False) -> DataFrame:
    """``docs`` without later copies of repeated runs of lines; columns and rows stay, ``n_chars`` follows the text.

    Null text stays null; a document that is a later copy as a whole keeps its row with what is left. Rows that agree in id and
    text are one document and lose the same lines; columns of any name may stand beside. Texts are
    shuffled once, to meet the list of their lines. With ``count``, ``n_lines_dropped`` is added.
    """
    columns = docs.columns
    keyed, k1, k2 = _keyed(docs)
    (gone,) = unused(keyed.columns, "_gone")
    dropped = later_copies(keyed, min_words, k1, k2).select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("gone").alias(gone))
    met = keyed.join(dropped, [k1, k2], "left")
    parts = F.split(F.col("text"), "\n", -1)

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(gone).isNull() | F.col("text").isNull(), F.col("text")).otherwise(let(parts, left))
    out = met.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    extra = [F.coalesce(F.size(gone), F.lit(0)).alias("n_lines_dropped")] if count else []
    return out.select(*columns, *extra)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after deletion of later copies, and how many lines went."""
    return drop_repeated_lines(table(spark, sf_dir, "documents"), count=True)
