"""License scans: word k-grams joined to licence templates, voted by diagonal, merged and verified as spans."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.common import computed

#: Words of a k-gram.
K = 4
#: Diagonals this far apart belong to one span (words put in or left out).
DIAGONAL_GAP = 3
#: Places of neighbouring diagonals further apart than this start another span.
PLACE_GAP = 40
#: Share of a template's words that a span must hold in place.
COVERAGE = 0.6

# Phrases that give a label wherever they stand.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Public licence notices and the label of each.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "distributed under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: ASCII other than lower-case letters and digits, character by character: Java looks such a class up in one table,
#: while it asks each range of a class in turn.
SPLIT = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)) + "]+"


def words_of(text: Column, lower: Callable[[Column], Column] | None = None) -> Column:
    """Words of letters, digits and characters above ASCII; null counts as empty.

    A-Z are lower-cased, other letters stay as they are, so that no ASCII word arises from others; or lower is used.
    """
    given = F.coalesce(text.cast("string"), F.lit(""))
    small = F.translate(given, ascii_uppercase, ascii_lowercase) if lower is None else lower(given)
    return F.array_remove(F.split(small, SPLIT), "")


def grams(words: Column) -> Column:
    """Hashes of every k words in turn; fewer words: none."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, K)]))


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, size in words, tpos and hash of each template's k-grams: a fixed, small table."""
    rows = [(i, label, text) for i, (label, text) in enumerate(TEMPLATES)]
    base = spark.createDataFrame(rows, "template int, label string, text string").select("template", "label", F.split("text", " ").alias("w"))
    return base.select("template", "label", F.size("w").alias("size"), F.posexplode(grams(F.col("w"))).alias("tpos", "h"))


def covered(places: Column) -> Column:
    """Words under k-grams that start at the given sorted places."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(-K).alias("last"))
    return F.aggregate(places, begin, lambda a, p: F.struct((a["n"] + F.least(F.lit(K), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, template, label, start, end (words from 0, end exclusive), coverage.

    Every k-gram hash of every text meets the template positions in an equi-join (the template table is a fixed
    constant and is broadcast); votes are summed per diagonal (word place minus template place) before the only
    shuffle's rows are compared; diagonals up to DIAGONAL_GAP apart whose places are near are merged; a span is
    verified by counting the template's words that stand in it, in place, and the words of the text it needs.
    """
    words = docs.select("doc_id", computed(words_of(F.col("text"))).alias("words"))
    placed = words.select("doc_id", F.posexplode(grams(F.col("words"))).alias("pos", "h"))
    votes = placed.join(F.broadcast(template_grams(docs.sparkSession)), "h").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    # One row per diagonal and block of the text, so that a text that repeats a notice a million times gathers no long list.
    lines = votes.groupBy("doc_id", "template", "label", "size", "diagonal").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.sort_array(F.collect_set("tpos")).alias("places"), F.count("*").alias("votes"))
    order = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > DIAGONAL_GAP) | (F.col("low") - F.lag("high").over(order) > PLACE_GAP)
    chained = lines.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = chained.groupBy("doc_id", "template", "label", "size", "span").agg(F.min("low").alias("start"), (F.max("high") + K).alias("end"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    share = covered(F.col("places")) / F.col("size")
    near = F.col("end") - F.col("start") <= 2 * F.col("size")
    return merged.select("doc_id", "template", "label", "start", "end", share.cast("double").alias("coverage")).where((F.col("coverage") >= COVERAGE) & near)


def base_hits(words: Column) -> Column:
    """Places of the fixed phrases as place * number of phrases + phrase, in order."""
    n = len(PHRASES)
    here = None
    for i, (phrase, _) in enumerate(PHRASES):
        first, *rest = phrase.split(" ")

        def stands(x: Column, at: Column, first: str = first, rest: list[str] = rest) -> Column:
            found = x == first
            for j, word in enumerate(rest):
                found &= F.get(words, at + (j + 1)) == word
            return found

        here = [*(here or []), (i, stands)]

    def code(x: Column, at: Column) -> Column:
        out = None
        for i, stands in here:
            value = at.cast("long") * n + i
            out = F.when(stands(x, at), value) if out is None else out.when(stands(x, at), value)
        return out

    return F.array_compact(F.transform(words, code))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    Null and empty texts have no words, no labels and score 0; columns of docs other than doc_id and text are
    dropped; spans belong to a row's own text, whether its doc_id is null or repeated. score is 1 with a phrase, else the
    best coverage of a verified span, else 0.
    """
    n = len(PHRASES)
    docs = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    words = docs.select("doc_id", computed(words_of(F.col("text"))).alias("words"))
    hit = words.select("doc_id", F.size("words").cast("long").alias("n_words"), base_hits(F.col("words")).alias("hits"))
    label = F.array(*[F.lit(x) for _, x in PHRASES])
    places = hit.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_base"),
        F.floor(F.array_min("hits") / n).cast("long").alias("first_word"),
        F.floor(F.array_max("hits") / n).cast("long").alias("last_word"),
        F.array_distinct(F.transform("hits", lambda x: F.get(label, F.pmod(x, F.lit(n)).cast("int")))).alias("base"),
    )
    own = spans(docs).groupBy("doc_id").agg(F.collect_set("label").alias("own"), F.max("coverage").alias("best"), F.count("*").alias("n_spans"))
    joined = places.join(own, "doc_id", "left")
    every = F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))
    return joined.select(
        "doc_id.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
