"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import distributed_rank, materialize, table, unused, word_count

#: Weights that the sources take in turn, in order of their code points with null last.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most often that a source may be repeated on average.
SHARE, MOST_COPIES = 1.5, 2


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source (``_none``, ``_name``) with ``source_size`` and ``target``.

    Sources share ``share`` of all sizes by weight; a target stops at ``most`` times its source's size, and what is over
    is shared again by weight. In closed form: with the sources in order of the level at which they fill up, the
    common level is that of the first source that does not. The windows run over one row per source.
    """
    sums = sized.groupBy("_none", "_name").agg(F.sum("size").cast("long").alias("source_size"))
    alone = Window.partitionBy(F.lit(0))
    place = F.row_number().over(alone.orderBy("_none", "_name")) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    src = sums.withColumn("w", F.get(turn, F.pmod(place, F.lit(len(weights))))).withColumn("cap", most * F.col("source_size").cast("double"))
    by_level = alone.orderBy(F.col("cap") / F.col("w"), "_none", "_name")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (share * F.sum("source_size").over(alone) - before) / open_w)
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(alone)
    src = src.withColumn("final", first["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("w") * F.col("final"), F.col("cap")))
    return src.select("_none", "_name", "source_size", target.cast("double").alias("target"))


def _offset(seed: int) -> Column:
    """A number from 0 to below 1 for each source, as any engine with md5 can make it."""
    digest = F.md5(F.concat(F.when(F.col("_none"), "1").otherwise("0"), "_name", F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / float(1 << 20)


def mix_plan(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 7, tie: str | None = None, **shares) -> DataFrame:
    """``sized`` (an id, a source, a long ``size``, perhaps a column ``tie``, anything else) with ``source_size``, ``target`` and ``copies``.

    Systematic sampling: within a source every document expects target / source size copies. The prefix sum of these
    over the documents in order of size, plus one random offset per source (20 bits of the md5 of its name and ``seed``), crosses
    as many integers at a document as it gets copies. Order by size makes the words taken come within about one
    document of the target. Documents of one size go by id, rows without an id first, then by ``tie`` (a hash of the text, say), so that reruns
    agree; rows that agree in all are interchangeable. Documents of size 0 take nothing and have no copies; a source of only such documents has target
    0; a null source is a source of its own; rows with one id are rows of their own; an empty table gives an empty plan.
    """
    keyed = sized.withColumn("_none", F.col(source_col).isNull()).withColumn("_name", F.coalesce(F.col(source_col), F.lit("")))
    keyed = materialize(keyed.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long"))), "mix-sizes")
    targets = source_targets(keyed, **shares)
    ranked = distributed_rank(keyed, ["_none", "_name"], ["size", "_id", *([tie] if tie else [])], "mix-rank")
    mixed = ranked.join(targets, ["_none", "_name"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mixed = mixed.withColumn("_each", each).withColumn("_u", _offset(seed))
    crossed = F.floor((F.col("rank") + 1) * F.col("_each") + F.col("_u")) - F.floor(F.col("rank") * F.col("_each") + F.col("_u"))
    copies = F.when(F.col("size") > 0, F.least(crossed, F.ceil("_each"))).otherwise(0).cast("long")
    return mixed.withColumn("copies", copies).drop("_none", "_name", "_id", "_each", "_u", "rank")


def mix_documents(docs: DataFrame, seed: int = 7, **shares) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns stay. Every repeat is a row of its own.

    The plan is made on ids and sizes; texts are shuffled once, to meet their number of copies. Rows that are equal in
    all columns are interchangeable: their copies are added up and emitted from one of them; maps are compared by their entries in order. A table
    without a ``source`` column counts as one source. Ids are cast to long.
    """
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    plain = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]  # maps have no hash
    k1, k2, number, place, copy = unused(docs.columns, "_k1", "_k2", "_copies", "_place", "_copy")
    key = {k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), k2: F.xxhash64(*plain)}
    sized = docs.select(F.col("doc_id"), source.alias("source"), word_count(F.col("text")).alias("size"), *[c.alias(k) for k, c in key.items()])
    copies = mix_plan(sized, seed=seed, tie=k2, **shares).groupBy(k1, k2).agg(F.sum("copies").cast("int").alias(number)).where(F.col(number) > 0)
    met = docs.withColumns(key).join(copies, [k1, k2])
    once = met.withColumn(place, F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(0)))).where(F.col(place) == 1)
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: how often and with how many words each document enters the mix."""
    docs = table(spark, sf_dir, "documents")
    plan = mix_plan(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("tie")), tie="tie")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
