"""License scans by diagonal voting.

Every text is a sequence of words, and so is every template. All rolling k-grams of a text are joined, by
hash, to the places of the templates that hold the same k-gram. A hit at word ``p`` of the text and word ``q`` of the
template votes for the diagonal ``p - q``: an unchanged copy puts all its votes on one diagonal and is accepted on
its own, however close the next copy stands. Inserted or missing words move the rest of a copy to neighbouring
diagonals. A copy with ``e`` such edits has all its diagonals within ``e + 1`` places of each other, so broken
diagonals are merged in windows of that width and no wider. A merged span counts if enough different places of the
template voted, and if its words are the template's but for one edit in ``WORDS_PER_EDIT``, word by word.

DataFrame expressions only. The templates are fixed values, so their table (one row per k-gram) may be
broadcast. A sentinel k-gram in front of each text joins a sentinel template, so texts without any hit
stay in the stream and nothing is joined back. Only hits and sentinels are shuffled, by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsluice.llm.common import ASCII_LOWER, ASCII_UPPER

K = 3
COVERAGE = 0.8
WORDS_PER_EDIT = 5
SENTINEL = 0
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that give a label wherever they stand (the base).
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Notices and names of public licenses that the method adds.
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("epl", "eclipse public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public "
            "license"),
    ("gpl", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
            "of the software and to permit persons to whom the software is furnished to do so"),
    ("mpl", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
            "was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications "
             "and to alter it and redistribute it freely"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` would also turn the Kelvin sign into a k, so such texts go the slow way."""
    return F.when(text.contains("K"), F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda w: w != "")


def gram(words: Column, at: Column) -> Column:
    """Hash of the ``K`` words from place ``at``, counted from 0; NULL words beyond the end are left out."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(K)])


def template_grams(spark: SparkSession) -> DataFrame:
    """``(hash, template, label, base, body, size, q)``: a row per k-gram, and the sentinel."""
    rows = [(i, label, base, body) for i, (base, label, body) in enumerate(
        [(True, *p) for p in PHRASES] + [(False, *t) for t in TEMPLATES])]
    names = ("template", "label", "base", "body")
    table = spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])))
    table = table.withColumn("parts", F.split("body", " ")).withColumn("size", F.size("parts"))
    grams = table.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - K)).alias("q")).select(
        gram(F.col("parts"), F.col("q")).alias("hash"), "template", "label", "base", "body", "size", "q")
    sentinel = spark.range(1).select(
        F.lit(SENTINEL).cast("long").alias("hash"), *[F.lit(None).cast(t).alias(n) for n, t in grams.dtypes[1:]])
    return grams.unionByName(sentinel)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``.

    ``spans`` lists what was found: label, first word, one past the last, share of the template's places that voted. NULL or
    empty texts have no words and no labels; repeated rows are answered each. An empty table gives no
    rows. Other columns are not read.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        words_of(F.col(text_col).cast("string")).alias("words"))
    grams = F.concat(
        F.array(F.lit(SENTINEL).cast("long")), F.transform("words", lambda w, i: gram(F.col("words"), i)))
    # A projection of its own: an explode of a plain column is compiled, and then the words of a text are
    # not copied for each of its k-grams. The outer form, or the optimizer would add a filter on the size of
    # the array and evaluate it twice.
    places = texts.withColumn("grams", grams).select("row", "id", "words", F.posexplode_outer("grams").alias("place", "hash"))
    hits = places.join(F.broadcast(template_grams(docs.sparkSession)), "hash").withColumn("parts", F.split("body", " "))
    # Equal hashes are confirmed by their words; the sentinel has no template.
    hits = hits.filter(F.col("template").isNull() | (
        F.slice("words", F.greatest("place", F.lit(1)), K) == F.slice("parts", F.col("q") + 1, K)))
    hits = hits.select(
        "row", "id", F.size("words").alias("n_words"), "template", "label", "base", "size", "body", "q",
        (F.col("place") - 1 - F.col("q")).alias("diagonal"))
    document = ["row", "id", "n_words"]
    template = ["template", "label", "base", "size", "body"]
    lines = hits.repartition("row").groupBy(*document, *template, "diagonal").agg(F.collect_set("q").alias("qs"))
    whole = F.coalesce(F.size("qs") == F.col("size") - K + 1, F.lit(False))
    edits = F.floor(F.col("size") / WORDS_PER_EDIT)
    lines = lines.withColumn("whole", whole).withColumn("slot", F.floor(F.col("diagonal") / (edits + 1)))
    lines = lines.filter(F.col("template").isNull() | F.col("whole") | (~F.col("base") & (edits > 0)))
    # A broken diagonal lies in two windows, each twice as wide as a copy's diagonals can be.
    slots = F.when(F.col("whole") | F.col("template").isNull(), F.array("diagonal")).otherwise(
        F.array(F.col("slot"), F.col("slot") - 1))
    windows = lines.withColumn("window", F.explode_outer(slots)).groupBy(*document, *template, "whole", "window").agg(
        F.collect_list(F.struct("diagonal", "slot", "qs")).alias("lines"))
    spans = windows.withColumn(
        "start", F.array_min(F.transform("lines", lambda x: x["diagonal"] + F.array_min(x["qs"])))).withColumn(
        "end", F.array_max(F.transform("lines", lambda x: x["diagonal"] + F.array_max(x["qs"]))) + K).withColumn(
        "share", F.size(F.array_distinct(F.flatten("lines.qs"))) / (F.col("size") - K + 1))
    # The window that begins with a copy's first diagonal answers for the copy.
    own = F.array_min("lines.slot") == F.col("window")
    found = F.when(F.col("template").isNull(), False).when(F.col("whole"), True).when(
        own & (F.col("share") >= COVERAGE), _distance() * WORDS_PER_EDIT <= F.col("size")).otherwise(False)
    spans = spans.withColumn("found", found)
    base = F.col("base") & F.col("found")
    out = spans.groupBy(*document).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct(
            F.col("start").alias("start"), F.col("end").alias("end"), "label", "share")))).alias("spans"))
    return out.drop("row")


def _distance() -> Column:
    """Edit distance in words between the template and the merged span.

    Each different word of the template is one character; words that no hit covers are blanks, which no template holds.
    """
    parts = F.split("body", " ")

    def sign(word: Column) -> Column:
        return F.char(F.lit(32) + F.array_position(parts, word))

    covered = F.flatten(F.flatten(F.transform("lines", lambda line: F.transform(line["qs"], lambda q: F.transform(
        F.sequence(F.lit(0), F.lit(K - 1)), lambda i: F.struct(
            (line["diagonal"] + q + i).alias("at"), sign(F.get(parts, q + i)).alias("sign")))))))
    signs = F.map_from_entries(F.array_distinct(covered))
    span = F.transform(F.sequence("start", F.col("end") - 1), lambda at: F.coalesce(F.try_element_at(signs, at), F.lit(" ")))
    return F.levenshtein(F.array_join(span, ""), F.array_join(F.transform(parts, sign), ""))
