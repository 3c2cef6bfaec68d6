"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import linededup, mixing, neardup, packing, quality
from lakeloom.llm import tokens as tok
from lakeloom.llm.common import dropped_after, materialize, table

#: Tokenizer of the packing stage; hundredths of similarity from which documents are near copies.
TOKENIZER, PERCENT = "word_bpe_49k.json", 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the decision list keeps. It is learned from all labels; the fixed base rules would reject short documents that are good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), base=False)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated runs of lines."""
    return linededup.drop_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.drop_near_duplicates(docs, PERCENT)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of a fixed window, with checksums of their ids."""
    path = tok.public_path(TOKENIZER)
    return packing.with_crc(packing.pack(docs, path), path)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("pack", pack_stage),
]

#: Token ids and minwise trees have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as parquet to the shared folder and read again, and what a stage wrote on its
    way there goes when its result stands. The last stage is the caller's to write."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with dropped_after(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", "zstd", scoped=False)
    return STAGES[-1][1](spark, docs, sf_dir)
