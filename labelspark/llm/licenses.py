"""License scans by diagonal voting, in DataFrame operations.

Every rolling word pair of a text is hashed and joined to its places in license
templates. A hit votes for the diagonal (place in the text minus place in the
template); a phrase stands where one diagonal has all votes, and a template is
found where neighbouring diagonals together cover enough of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Word characters after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Sentences that licenses are known by, found with small changes too.
TEMPLATES = [
    ("gpl-statement", "this work is licensed under the gnu general public license version"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit-release", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

MIN_COVER = 0.85  # share of a template's word pairs
NEIGHBOUR = 2  # diagonals this close belong to one span
STRETCH = 1.5  # a span may be this many times as long as its template
_NOTHING = 0  # hash of the extra row that every text sends along


def words_of(text: Column) -> Column:
    """``lower`` changes A-Z alike in all texts; other letters stay word characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def pair_hashes(words: Column) -> Column:
    shifted = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(first, shifted, lambda a, b: F.xxhash64(a, b))


def template_places(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(hash, template, label, phrase, pairs, at): one row per word pair of a
    template. Texts need two words or more. A constant of the library, so small
    enough to broadcast."""
    entries = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    if any(len(text.split()) < 2 for _, text, _ in entries):
        raise ValueError("a template needs two words")
    rows = F.array(*[
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), F.split(F.lit(text), " ").alias("words"))
        for i, (label, text, phrase) in enumerate(entries)
    ])
    listed = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    listed = listed.withColumn("_pairs", pair_hashes(F.col("words")))
    return listed.select(
        "template", "label", "phrase", F.size("_pairs").alias("pairs"), F.posexplode("_pairs").alias("at", "hash")
    )


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans.

    ``n_base`` counts places of the phrases, which overlap freely; ``spans`` lists
    the verified template spans (label, first word, end, cover). ``score`` is the
    best cover of any template or phrase. A null or empty text has no word and
    scores 0. Rows with equal id and text, null ids included, get equal results,
    one each. Other columns are not read.
    """
    spark = docs.sparkSession
    places = template_places(spark, phrases, templates)
    extra = places.limit(0).unionByName(
        spark.range(1).select(
            F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("phrase"), F.lit(1).alias("pairs"),
            F.lit(0).alias("at"), F.lit(_NOTHING).cast("bigint").alias("hash"),
        )
    )
    places = places.filter(F.col("hash") != _NOTHING).unionByName(extra)
    words = words_of(F.col("text"))
    hits = (
        docs.select("doc_id", F.xxhash64("text").alias("_text"), words.alias("_words"))
        .select("doc_id", "_text", F.size("_words").alias("n_words"), pair_hashes(F.col("_words")).alias("_pairs"))
        .select(
            "doc_id", "_text", "n_words",
            F.posexplode(F.concat(F.array(F.lit(_NOTHING).cast("bigint")), "_pairs")).alias("_place", "hash"),
        )
        .join(F.broadcast(places), "hash")
        .withColumn("diagonal", F.col("_place") - 1 - F.col("at"))
    )
    row = ["doc_id", "_text", "n_words"]
    kind = ["template", "label", "phrase", "pairs"]
    votes = hits.groupBy(*row, *kind, "diagonal").agg(
        F.collect_set("at").alias("voters"), F.count(F.lit(1)).alias("rows")
    )
    near = W.partitionBy(*row, "template").orderBy("diagonal")
    jump = (F.col("diagonal") - F.lag("diagonal").over(near) > NEIGHBOUR).cast("int")
    votes = votes.withColumn("_span", F.sum(F.coalesce(jump, F.lit(0))).over(near))
    full = F.col("phrase") & (F.size("voters") == F.col("pairs"))
    spans = votes.groupBy(*row, *kind, "_span").agg(
        F.count_if(full).alias("n_full"),
        F.min(F.when(full, F.col("diagonal"))).alias("first_full"),
        F.max(F.when(full, F.col("diagonal"))).alias("last_full"),
        F.max(F.size("voters")).alias("most"),
        F.array_distinct(F.flatten(F.collect_list("voters"))).alias("voters"),
        F.min(F.col("diagonal") + F.array_min("voters")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("voters") + 2).alias("end"),
        F.max("rows").alias("rows"),
    )
    real = F.col("template") >= 0
    # a phrase must stand word for word: only a single diagonal counts for it
    cover = F.when(F.col("phrase"), F.col("most")).otherwise(F.size("voters")) / F.col("pairs")
    tight = F.col("end") - F.col("start") <= F.ceil((F.col("pairs") + 1) * STRETCH)
    found = ~F.col("phrase") & (cover >= MIN_COVER) & tight
    span = F.struct("label", "start", "end", cover.alias("cover"))
    base = F.when(F.col("n_full") > 0, F.col("label"))
    texts = spans.groupBy(*row).agg(
        F.sum("n_full").alias("n_base"),
        F.min("first_full").cast("bigint").alias("first_word"),
        F.max("last_full").cast("bigint").alias("last_word"),
        F.collect_set(base).alias("_base"),
        F.collect_set(F.when(real & (found | (F.col("n_full") > 0)), F.col("label"))).alias("_labels"),
        F.max(F.when(real, cover).otherwise(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(real & found, span))).alias("spans"),
        F.max(F.when(~real, F.col("rows"))).alias("_copies"),
    )
    texts = texts.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return texts.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.col("n_base").cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort("_labels"), ",").alias("labels"),
        "score",
        "spans",
    )
