"""License scans: exact phrases, and diagonal voting of word k-grams against license notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import let, materialize, table

#: Fixed phrases (words in their order) and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices as they are commonly written in files, with their labels; a parameter of the operator.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
        
    ("mit",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
        
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
        
    ("apache", "licensed under the apache license version 2 0"),
    ("apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
        
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
        
    ("gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
        
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
        
    ("unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
        
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced or transmitted in any form"),
)
#: Words of a k-gram; diagonals this near each other are one alignment; share of a notice's words that it must cover.
K, DRIFT, COVER = 3, 2, 0.7
#: Most words of all notices together: their k-grams are broadcast.
NOTICE_WORDS = 200_000
WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. Null text has none.

    ``lower`` is the fast path; texts with one of the two characters whose lower case is an ASCII letter take
    ``translate``, and other capitals beyond ASCII stay within their words either way.
    """
    t = F.coalesce(text, F.lit(""))
    lowered = F.when(t.contains("K") | t.contains("İ"), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))
    return F.filter(F.split(lowered, WORD_BREAK, -1), lambda w: w != F.lit(""))


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """One row per place of a notice: ``template``, ``label``, ``t_pos``, ``gram`` (hash), ``gram_words`` and ``t_words`` (its length)."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    ws = license_words(F.col("text"))
    grams = let(ws, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.struct((i - 1).alias("t_pos"), F.slice(w, i,
        k).alias("gram_words"), F.size(w).alias("t_words"))))
    return rows.select("template", "label", F.explode(grams).alias("g")).select("template", "label", "g.t_pos", "g.t_words", "g.gram_words",
        F.xxhash64("g.gram_words").alias("gram"))


def _phrase_places(ws: Column, phrases=PHRASES) -> Column:
    """Array of (place, label) where a phrase's words stand one after the other."""

    def at(phrase: str) -> Column:
        want = phrase.split(" ")
        places = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(ws, i + j) == w, F.lit(False)) for j, w in enumerate(want)]))
        return places

    joined = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    none = F.array().cast("array<struct<at:int,label:string>>")

    def found(text: Column) -> Column:
        def labelled(p: str, label: str) -> Column:
            places = F.transform(at(p), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
            return F.when(text.contains(f" {p} "), places).otherwise(none)

        return F.concat(*[labelled(p, label) for p, label in phrases])

    return let(joined, found)


def scan(docs: DataFrame, templates=TEMPLATES, k: int = K, drift: int = DRIFT, cover: float = COVER) -> DataFrame:
    """``docs`` ids with phrase places, labels and the best score of a notice.

    The rolling k-grams of whole texts are hashed in place, joined with the places of the notices (a bounded table), and
    each hit votes for its diagonal, document place minus notice place. Diagonals within ``drift`` of each other are
    merged, so that a few inserted or lost words don't break an alignment. An alignment is verified as a span: the words of its
    hits (compared as words, not hashes) must cover ``cover`` of the notice, and its span in the document (``spans``) must not hold more than as many words
    again as the notice, so that scattered k-grams of a long text don't add up. Before the join, k-grams whose hash no notice has
    are left out in place. Votes of a document are summed map-side; the windows see the diagonals of one document and notice.
    Null and empty texts have no words, places or labels. Rows with one id are rows of their own.
    """
    spark = docs.sparkSession
    if sum(len(text.split()) for _, text in templates) > NOTICE_WORDS:
        raise ValueError(f"notices of more than {NOTICE_WORDS} words: they are broadcast")
    grams = template_grams(spark, templates, k)
    hashes = [r["gram"] for r in grams.select("gram").distinct().collect()]  # bounded by the notices' words

    def of(ws: Column) -> Column:
        rolled = F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i,
            k)))).otherwise(F.array().cast("array<bigint>"))
        at = F.transform(rolled, lambda h, i: F.when(h.isin(hashes), i))
        hits = F.transform(F.filter(at, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("d_pos"), F.slice(ws, i + 1, k).alias("gram_words")))
        return F.struct(F.size(ws).cast("long").alias("n_words"), _phrase_places(ws).alias("base"), hits.alias("hits"))

    parsed = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), let(license_words(F.col("text")), of).alias("s"))
    parsed = materialize(parsed.select("doc_id", "_row", "s.*"), "license-hits")
    votes = parsed.where(F.size("hits") > 0).select("_row", F.explode("hits").alias("h")).select("_row", "h.d_pos", "h.gram_words").join(F.broadcast(grams), "gram_words")
    votes = votes.withColumn("diagonal", F.col("d_pos") - F.col("t_pos"))
    lines = votes.groupBy("_row", "template", "label", "t_words", "diagonal").agg(F.collect_set("t_pos").alias("places"), F.min("d_pos").alias("lo"), F.max("d_pos").alias("hi"))
    by_diagonal = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > drift, F.lit(True)).cast("int")
    lines = lines.withColumn("_new", apart).withColumn("alignment", F.sum("_new").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy("_row", "template", "label", "t_words",
        "alignment").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # verification: distinct words of the notice that the alignment covers
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    tight = F.col("hi") + k - F.col("lo") <= 2 * F.col("t_words")
    spans = merged.withColumn("score", covered / F.col("t_words")).where((F.col("score") >= cover) & tight)
    found = spans.groupBy("_row").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct(F.col("lo").alias("first_word"), (F.col("hi") + k - 1).alias("last_word"), "label",
        "score"))).alias("spans"))
    return parsed.drop("hits").join(found, "_row", "left").drop("_row")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: phrase places and labels of every document; score is 1 with a phrase, else that of the best notice."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    both = F.array_sort(F.array_union(F.array_distinct(F.transform("base", lambda b: b["label"])), F.coalesce("found", F.array().cast("array<string>"))))
    at = F.transform("base", lambda b: b["at"].cast("long"))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("score", F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        score.cast("double").alias("score"))
