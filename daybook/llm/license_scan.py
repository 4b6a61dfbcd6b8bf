"""License scan: an exact set-similarity join of license templates with blocks of text.

A block is a window of words; windows step by STRIDE and overlap, so any passage as long as the longest template lies
in one of them. A template matches each block that holds at least ``threshold`` of its distinct words. The words of
all templates are ordered by how often they are in the whole corpus, rarest first, and three filters come before the
count of common words: a matching pair shares a word among the first |T| - need + 1 of the template and the first
|B| - need + 1 of the block (prefix); the block has at least ``need`` of the words (length); and at the first shared
word enough words follow on either side (position). A phrase template must besides stand in the text word by word.

Only DataFrame functions. The one thing that is brought back is the count of each template word.

Defined cases: a NULL or empty text has no words and no labels; a NULL id is an id like any other; rows that repeat
get the same result each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import ascii_lower
from daybook.session import materialize

THRESHOLD = 0.8
STRIDE = 64
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed values: (label, words, kind). A phrase stands word by word; a notice is compared as a set.
PHRASES = [
    ("mit", "under the mit license", "phrase"),
    ("apache-2", "apache license version 2", "phrase"),
    ("cc-by-nc", "cc by nc", "phrase"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "notice"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at www apache org", "notice"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "notice"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "notice"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "notice"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "notice"),
]
TEMPLATES = PHRASES + NOTICES


def need(words: list[str], threshold: float) -> int:
    """Distinct words a block must hold."""
    return max(1, math.ceil(threshold * len(set(words)) - 1e-9))


def text_words(text: Column) -> Column:
    """Words of the whole text; split leaves an empty string where it starts or ends with a gap."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def ordered_vocabulary(docs: DataFrame, text: str, templates: list[tuple[str, str, str]]) -> list[str]:
    """Words of the templates, those rarest in the corpus first. One count per template word comes to the driver."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    words = docs.select(F.explode(text_words(F.col(text))).alias("w")).filter(F.col("w").isin(vocabulary))
    seen = {r.w: r["count"] for r in words.groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def template_index(docs: DataFrame, order: list[str], templates: list[tuple[str, str, str]], threshold: float) -> DataFrame:
    """One row per word in the prefix of a template: _w (its place in the order), _i (its place in the template)."""
    rows = []
    for t, (label, words, kind) in enumerate(templates):
        ranks = sorted({order.index(w) + 1 for w in words.split()})
        n = need(words.split(), threshold)
        for i, w in enumerate(ranks[: len(ranks) - n + 1]):
            rows.append(
                F.struct(
                    F.lit(w).alias("_w"), F.lit(i).alias("_i"), F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(kind).alias("kind"),
                    F.lit(n).alias("_need"), literals(ranks).alias("_ranks"), literals(words.split()).alias("_phrase"),
                )
            )
    return docs.sparkSession.range(1).select(F.inline(F.array(*rows)))


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD, stride: int = STRIDE
) -> tuple[DataFrame, DataFrame]:
    """(rows, matches). ``rows``: _id, _hash, n_words of each document. ``matches``, one row per block and template:
    _id, _hash, block (its first word is block * stride), template, label, kind, overlap, containment, starts (words at
    which a phrase stands)."""
    width = stride + max(len(t.split()) for _, t, _ in templates) - 1
    order = ordered_vocabulary(docs, text, templates)
    first = sorted({w for _, t, _ in templates for w in sorted(set(t.split()), key=order.index)[: len(set(t.split())) - need(t.split(), threshold) + 1]})
    words = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text_words(F.col(text)).alias("_words"))
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / stride).cast("int")),
        lambda b: F.struct(b.alias("block"), F.slice("_words", b * stride + 1, width).alias("words")),
    )
    hit = F.filter(cut, lambda x: F.arrays_overlap(x["words"], literals(first)))
    held = F.when(F.arrays_overlap("_words", literals(first)), hit)
    rows = materialize(words.select("_id", "_hash", F.size("_words").cast("long").alias("n_words"), held.alias("_blocks")), "license-blocks")

    blocks = rows.filter("_blocks is not null").select("_id", "_hash", F.inline("_blocks"))
    ranks = F.filter(F.transform("words", lambda w: F.array_position(literals(order), w).cast("int")), lambda r: r > 0)
    blocks = blocks.withColumn("_set", F.array_sort(F.array_distinct(ranks)))
    probes = blocks.select("*", F.posexplode("_set").alias("_j", "_w"))
    # bounded: the index has a row per word in a prefix of the given templates
    pairs = probes.join(F.broadcast(template_index(docs, order, templates, threshold)), "_w")
    b, t = F.size("_set"), F.size("_ranks")
    pairs = pairs.filter((b >= F.col("_need")) & (F.col("_j") <= b - F.col("_need")))
    pairs = pairs.filter(F.least(t - F.col("_i"), b - F.col("_j")) >= F.col("_need"))
    # of the words that a pair shares in both prefixes, the first alone counts
    pairs = pairs.filter(~F.arrays_overlap(F.slice("_set", F.lit(1), F.col("_j")), F.slice("_ranks", F.lit(1), F.col("_i"))))
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("_set", "_ranks"))).filter("overlap >= _need")
    places = F.expr(f"filter(sequence(0, {stride} - 1), i -> slice(words, i + 1, size(_phrase)) = _phrase)")
    starts = F.when(F.col("kind") == "phrase", F.transform(places, lambda i: (F.col("block") * stride + i).cast("long")))
    pairs = pairs.withColumn("starts", starts).filter("kind <> 'phrase' or size(starts) > 0")
    matches = pairs.select("_id", "_hash", "block", "template", "label", "kind", "overlap", (F.col("overlap") / t).alias("containment"), "starts")
    return rows.select("_id", "_hash", "n_words"), matches.dropDuplicates(["_id", "_hash", "block", "template"])


def document_labels(docs: DataFrame, **options) -> DataFrame:
    """One row per document: _id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest
    containment of a match, 0 without any)."""
    rows, matches = scan(docs, **options)

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    per = matches.groupBy("_id", "_hash").agg(
        F.sum(F.coalesce(F.size("starts"), F.lit(0)) * (F.col("kind") == "phrase").cast("int")).cast("long").alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        joined(F.collect_set(F.when(F.col("kind") == "phrase", F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("containment").alias("score"),
    )
    a, b = rows.alias("a"), per.alias("b")
    got = a.join(b, F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._hash") == F.col("b._hash")), "left")
    return got.select(
        "a._id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
