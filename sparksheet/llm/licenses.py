"""License scans by diagonal voting, in DataFrame functions only.

A text's words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters, cut once.  Every rolling k-gram of
words is hashed and joined to the templates' k-grams; a hit, verified by the words themselves, votes for its diagonal
(place in the text less place in the template).  Neighbouring diagonals (at most `slip` apart) are merged, so that a few
inserted or dropped words do not split a match; chains of diagonals that run over more than the template's length are
cut into stretches of that length, once from their start and once half a length off.  A merged diagonal is a span if it
covers `cover` of the template's k-grams.  Fixed phrases are looked up beside that and always stay.

Templates are a parameter table; their k-grams are broadcast up to `broadcast_grams` rows and shuffled beyond.  With the
k-grams of a text goes one row for the text itself, so that one scan and one pass of shuffles serve both.

Defined cases: null and empty texts have no words and no labels; equal rows (same id, same text) get equal
values, each keeping its row; templates with fewer than k words are looked up with k cut to their length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """The text's words, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def grams(ws: Column, k: int) -> Column:
    """All k-grams of words by place: at, k, gram (its words), hash; empty if there are fewer words."""
    n = F.size(ws) - k
    gram = lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(k)])
    made = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), gram(i).alias("gram")))
    return F.when(n >= 0, made).otherwise(F.array().cast("array<struct<at:int,k:int,gram:string>>"))


def places(ws: Column, phrase: str) -> Column:
    """Starts of the phrase's words standing consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(ws, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            out = out & (F.get(ws, i + j) == p)
        return F.coalesce(out, F.lit(False))

    hit = F.array_contains(ws, parts[-1]) & (F.size(ws) >= len(parts))
    return F.when(hit, F.filter(F.sequence(F.lit(0), F.greatest(F.size(ws) - len(parts), F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def template_grams(spark: SparkSession, templates, k: int) -> DataFrame:
    """template, label, words, grams (how many), hash, k, gram, place.  templates: (label, text); of fewer than k words: with k cut to their number."""
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(templates)], "template int, label string, text string")
    t = t.withColumn("w", words(F.col("text"))).withColumn("words", F.size("w")).where("words > 0")
    own = F.coalesce(*[F.when(F.col("words") == n, grams(F.col("w"), n)) for n in range(1, k)], grams(F.col("w"), k))
    t = t.withColumn("g", own).select("template", "label", "words", F.size("g").alias("grams"), F.explode_outer("g").alias("x"))
    return t.select("template", "label", "words", "grams", F.xxhash64("x.gram").alias("hash"), F.col("x.k").alias("k"), F.col("x.gram").alias("gram"), F.col("x.at").alias("place"))


def _labelled(label: str):
    return lambda at: F.struct(at.alias("at"), F.lit(label).alias("label"))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, k: int = 3, slip: int = 2, cover: float = 0.6, broadcast_grams: int = 100_000) -> DataFrame:
    """id_col, n_words, base array<struct<at, label>> (phrases), spans array<struct<label, template, first, last, score>> for each row of df."""
    known = template_grams(df.sparkSession, templates, k)
    lengths = sorted({min(k, len(re.findall(WORD, text.lower()))) for _, text in templates} - {0}) or [k]
    if sum(len(re.findall(WORD, text.lower())) for _, text in templates) <= broadcast_grams:
        known = F.broadcast(known)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")).select("id", F.xxhash64("id", "t").alias("key"), words(F.col("t")).alias("ws"))
    base = F.array_sort(F.concat(*[F.transform(places(F.col("ws"), p), _labelled(label)) for p, label in PHRASES]))
    own = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("k"), F.lit("").alias("gram"))  # the text itself
    facts = rows.select("id", "key", F.size("ws").cast("long").alias("n_words"), base.alias("base"), F.concat(F.array(own), *[grams(F.col("ws"), n) for n in lengths]).alias("xs"))
    # There is always one: explode would test the arrays' sizes first, and make them twice for that.
    each = facts.select("id", "key", "n_words", "base", F.explode_outer("xs").alias("x"))
    is_text = F.col("x.at") < 0
    each = each.select("id", "key", F.when(is_text, F.col("n_words")).alias("n_words"), F.when(is_text, F.col("base")).alias("base"), F.col("x.at").alias("at"), F.col("x.k").alias("k"), F.col("x.gram").alias("gram"), F.xxhash64("x.gram").alias("hash"))
    hits = each.join(known, ["hash", "k", "gram"], "left").where("template is not null or at < 0")
    by = ["key", "template", "label", "grams", "words"]
    votes = hits.groupBy(*by, "k", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("placed"), F.min("at").alias("first"), F.max("at").alias("last"), F.first("id", ignorenulls=True).alias("id"), F.max("n_words").alias("n_words"), F.first("base", ignorenulls=True).alias("base"), F.count(F.lit(1)).alias("rows")
    )
    order = W.partitionBy("key", "template").orderBy("diagonal")
    # A template of fewer than k words has one gram: nothing to merge, so each place is a span of its own.
    reach = F.when(F.col("words") < k, 0).otherwise(slip)
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > reach).cast("int"), F.lit(1))
    chained = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    chain = W.partitionBy("key", "template", "run")
    low, high = F.min("diagonal").over(chain), F.max("diagonal").over(chain)
    chained = chained.withColumn("low", low).withColumn("long", high - F.col("low") >= F.col("words"))
    shift = lambda half: F.floor((F.col("diagonal") - F.col("low") + half) / F.col("words")).cast("int")
    chained = chained.withColumn("cells", F.when(F.col("long"), F.array(2 * shift(F.lit(0)), 2 * shift(F.col("words") / 2) + 1)).otherwise(F.array(F.lit(0))))
    stretches = chained.withColumn("cell", F.explode("cells")).groupBy(*by, "k", "run", "cell").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("placed")))).alias("placed"), F.min("first").alias("first"), (F.max("last") + F.col("k") - 1).alias("last"), F.first("id", ignorenulls=True).alias("id"), F.max("n_words").alias("n_words"), F.first("base", ignorenulls=True).alias("base"), F.max("rows").alias("rows")
    )
    score = F.col("placed") / F.col("grams")
    is_span = F.col("template").isNotNull() & (score >= cover)
    span = F.when(is_span, F.struct("label", "template", "first", "last", score.alias("score")))
    of_text = F.col("template").isNull()
    out = stretches.groupBy("key").agg(F.first("id", ignorenulls=True).alias("id"), F.max("n_words").alias("n_words"), F.first("base", ignorenulls=True).alias("base"), F.max(F.when(of_text, F.col("rows"))).alias("rows"), F.array_sort(F.collect_set(span)).alias("spans"))
    return out.select(F.col("id").alias(id_col), "n_words", "base", "spans", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(id_col, "n_words", "base", "spans")
