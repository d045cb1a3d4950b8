"""License scan: an exact set-similarity join of text blocks with license templates.

All of it is column expressions and joins; texts are read once for the token counts and once for
the blocks, and are never shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.session import materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STRIDE = 64, 32
THRESHOLD = 0.8

# Phrases whose words must stand one after another, and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The opening words of common licenses and notices; each has at most STRIDE + 1 words, so that
# some block holds it whole.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
           "software and associated documentation files, to deal in the Software without "
           "restriction",
    "mit-line": "Released under the MIT License",
    "apache": "you may not use this file except in compliance with the License. You may obtain a "
              "copy of the License at http www apache org licenses",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under "
                  "the terms of the GNU General Public License as published by the Free Software "
                  "Foundation",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are "
           "permitted provided that the following conditions are met",
    "cc-attribution": "This work is licensed under a Creative Commons Attribution 4.0 "
                      "International License",
    "cc-line": "Licensed under CC BY-NC 4.0",
}


@dataclass(frozen=True)
class Template:
    label: str
    tokens: list[int]     # places in the global order, rarest first
    least: int            # tokens that must be shared

    @property
    def prefix(self) -> list[int]:
        """A set that shares ``least`` tokens with the template shares one of these."""
        return self.tokens[:len(self.tokens) - self.least + 1]


def template_words(text: str) -> set[str]:
    return set(re.findall(r"[0-9a-z]+", text.lower()))


def _words(text: Column) -> Column:
    """Words in lower case. Beyond A-Z this also lowers other letters, which no phrase has."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _starts(words: Column, joined: Column, phrase: str) -> Column:
    """Places where the phrase's words stand, or null if they stand nowhere."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i):
        test = F.lit(True)
        for k, part in enumerate(parts):
            test = test & (F.get(words, i + k) == part)
        return test
    return F.when(joined.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), last), here))


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and non-ASCII characters. n_base counts the places of the
    fixed phrases; first_word and last_word are their smallest and largest start. A template's
    label is added if some block of ``BLOCK`` words (one every ``STRIDE``) contains at least
    ``threshold`` of the template's distinct words. The score is 1 with a phrase, else the highest
    containment that met the threshold, else 0.

    The join is exact. Tokens are ordered by how often they occur in all documents, rarest first;
    only tokens of templates matter to a containment, so only those are kept. A block and a
    template that share enough tokens share one of their first few (prefix filter); a pair is
    dropped if the block is too small (length filter) or too little is left after the shared token
    on either side (positional filter); the rest is counted in full. Templates are given, so the
    token table and the template side have a size known beforehand; only they are broadcast.

    Null and empty texts have no words: counts of 0, null places, empty labels, score 0. Rows with
    a null or repeated id are judged by their own text. An empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted(set().union(*[template_words(t) for t in templates.values()]) or {""})
    counted = (docs.select(F.explode(_words(F.col(quoted(text_column)))).alias("word"))
               .where(F.col("word").isin(vocabulary)).groupBy("word").count().collect())
    seen = {row["word"]: row["count"] for row in counted}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    sets = []
    for label, text in templates.items():
        tokens = sorted(order[w] for w in template_words(text))
        if tokens:
            sets.append(Template(label, tokens, math.ceil(threshold * len(tokens) - 1e-9)))
    rows = materialize(_rows(docs, id_column, text_column, order, sets), "license-rows")
    found = _matches(rows, sets)
    base = [F.when(F.size(F.coalesce(c, F.array().cast("array<int>"))) > 0, F.lit(label))
            for c, label in zip([F.col(f"at_{k}") for k in range(len(PHRASES))], PHRASES.values())]
    places = F.flatten(F.array(*[F.coalesce(f"at_{k}", F.array().cast("array<int>"))
                                 for k in range(len(PHRASES))]))
    base_labels = F.array_sort(F.array_compact(F.array(*base)))
    joined = rows.drop("blocks").join(found, ["key", "ident"], "left")
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_column), F.col("n_words").cast("bigint").alias("n_words"),
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
        .alias("score"))


def _rows(docs: DataFrame, id_column: str, text_column: str, order: dict[str, int],
          sets: list[Template]) -> DataFrame:
    """One narrow row per document: counts, phrase places, and blocks where a prefix token occurs."""
    ident, text = F.col(quoted(id_column)), F.col(quoted(text_column))
    split = docs.select(ident.alias("id"), F.xxhash64(ident, text).alias("key"),
                        F.coalesce(ident.cast("string"), F.lit("")).alias("ident"),
                        _words(text).alias("words"))
    split = split.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    words, n = F.col("words"), F.size("words")
    by_place = {k: w for w, k in order.items()}
    rare = [by_place[k] for k in sorted({k for s in sets for k in s.prefix})]
    known = list(order)
    places = F.create_map(*[F.lit(x) for w, k in order.items() for x in (w, k)])
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil((n - STRIDE) / STRIDE), F.lit(1)).cast("int") - 1),
        lambda b: F.array_sort(F.array_distinct(F.transform(
            F.filter(F.slice(words, b * STRIDE + 1, BLOCK), lambda w: w.isin(known)),
            lambda w: places[w]))))
    touched = F.arrays_overlap(words, F.array(*[F.lit(w) for w in rare])) if rare else F.lit(False)
    return split.select(
        "id", "key", "ident", n.alias("n_words"),
        *[_starts(words, F.col("joined"), p).alias(f"at_{k}") for k, p in enumerate(PHRASES)],
        F.when(touched, blocks).alias("blocks"))


def _matches(rows: DataFrame, sets: list[Template]) -> DataFrame:
    """Per document, labels of the templates that some block contains, and the best containment."""
    spark = rows.sparkSession
    schema = ("token int, place int, label string, tokens array<int>, least int")
    table = spark.createDataFrame(
        [(k, place, s.label, s.tokens, s.least) for s in sets for place, k in enumerate(s.prefix)],
        schema)
    smallest = min([s.least for s in sets], default=1)
    blocks = (rows.where("blocks IS NOT NULL")
              .select("key", "ident", F.posexplode("blocks").alias("block", "held"))
              .withColumn("size", F.size("held")).where(F.col("size") >= smallest))
    probes = blocks.select("*", F.posexplode(F.slice("held", F.lit(1), F.col("size") - smallest + 1))
                           .alias("held_place", "token"))
    pairs = (probes.join(F.broadcast(table), "token")
             .where("size >= least")
             .where(F.least(F.col("size") - F.col("held_place"),
                            F.size("tokens") - F.col("place")) >= F.col("least")))
    shared = F.size(F.array_intersect("held", "tokens"))
    return (pairs.withColumn("shared", shared).where("shared >= least")
            .groupBy("key", "ident")
            .agg(F.collect_set("label").alias("found"),
                 F.max(F.col("shared") / F.size("tokens")).alias("containment")))
