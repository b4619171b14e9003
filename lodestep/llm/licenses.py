"""License scan: phrases, and an exact set-similarity join with license templates. DataFrame functions only.

Texts are cut into overlapping blocks of ``2 * STRIDE`` words, so that every run of
STRIDE words, the longest template, lies within one block. A block matches a
template where it holds at least ``threshold`` of the template's distinct words. The
join is exact and doesn't compare all pairs. All words have one global order,
rarest first by the number of documents that hold them. A match needs at least
``need`` common words, so

* prefix: some word among the template's first ``size - need + 1`` is among the
  block's first ``size - need + 1`` in that order;
* length: the block has at least ``need`` words that occur in templates;
* position: at the first common word, what follows on both sides is long enough.

Pairs that pass are counted in full. The order is counted over all documents;
only template words matter for it, so it has a bounded number of rows.

Words are runs of ASCII letters and digits, A-Z lowered, and of anything beyond
ASCII. Defined results: a null text has no words, no places and score 0. Rows are
matched by themselves, whatever their ids.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, ascii_lower, hash128, quoted, written

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening words or notices of well-known public licenses, by label.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc0": ["To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Released under the MIT License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "reserved": ["Copyright. All rights reserved. No part of this publication may be reproduced or distributed in any form without prior written permission"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
STRIDE = 40
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_in(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def template_sets(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(label, sorted distinct words) of each template."""
    return [(label, sorted(set(words_in(t)))) for label, texts in sorted(templates.items()) for t in texts]


def stride_of(templates: dict[str, list[str]] = TEMPLATES) -> int:
    """How far blocks are apart: STRIDE, or the words of the longest template. Blocks are twice as long, so one of them holds any template as a whole."""
    return max([STRIDE, *(len(words_in(t)) for texts in templates.values() for t in texts)])


def _array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _split(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(quoted(text)), F.lit(""))), _BETWEEN), lambda w: w != "")
    return docs.select(*(F.col(quoted(c)) for c in keep), *([F.col(quoted(text)).alias(P + "text")] if keep else []), words.alias(P + "words"))


def word_order(docs: DataFrame, vocabulary: list[str], text: str = "text") -> list[str]:
    """The vocabulary, rarest word first by documents that hold it; a row for each word at most."""
    held = _split(docs, [], text).select(F.explode(F.array_intersect(P + "words", _array(vocabulary))).alias("w"))
    n = {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _places() -> Column:
    """Starts of all phrases as (start, label). Only texts that hold a phrase are gone through word by word."""
    words = F.col(P + "words")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    none = F.array().cast("array<struct<at:int,label:string>>")
    return F.concat(*(F.when(F.contains(joined, F.lit(f" {phrase} ")), _starts(words, phrase.split(), label)).otherwise(none) for phrase, label in PHRASES.items()))


def _starts(words: Column, phrase: list[str], label: str) -> Column:
    """Where the phrase's words stand one after the other, as (at, label)."""

    def stands(w, i):
        same = w == phrase[0]
        for k in range(1, len(phrase)):
            same = same & F.coalesce(F.get(words, i + k) == phrase[k], F.lit(False))
        return F.when(same, i)

    found = F.filter(F.transform(words, stands), lambda i: i.isNotNull())
    return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


class _Templates:
    """The templates as the join needs them: words in the global order, prefixes with their places."""

    def __init__(self, docs: DataFrame, text: str, threshold: float, templates: dict[str, list[str]]):
        self.sets, self.stride = template_sets(templates), stride_of(templates)
        self.order = word_order(docs, sorted({w for _, s in self.sets for w in s}), text)
        rank = {w: i for i, w in enumerate(self.order)}
        self.index = []
        for number, (label, found) in enumerate(self.sets):
            need = math.ceil(round(threshold * len(found), 9))
            own = sorted(found, key=rank.__getitem__)
            self.index += [(w, number, label, i, len(own), need, own) for i, w in enumerate(own[: len(own) - need + 1])]

    def prefixes(self, spark: SparkSession) -> DataFrame:
        quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        values = ", ".join(f"({quote(w)}, {n}, {quote(label)}, {i}, {size}, {need}, array({', '.join(map(quote, own))}))" for w, n, label, i, size, need, own in self.index)
        return spark.sql(f"select * from values {values} as t(w, template, label, i, size, need, own)")

    def blocks(self) -> Column:
        """(block, held) of the blocks that hold a prefix word: number, and which template words are in it, rarest first."""
        words, rare = F.col(P + "words"), _array(sorted({x[0] for x in self.index}))
        at = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(rare, w), i)), lambda i: i.isNotNull())
        numbers = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / self.stride), F.greatest(F.floor(i / self.stride) - 1, F.lit(0))))))
        held = F.transform(numbers, lambda b: F.struct(b.cast("bigint").alias("block"), F.array_intersect(_array(self.order), F.slice(words, (b * self.stride + 1).cast("int"), 2 * self.stride)).alias("held")))
        return F.when(F.arrays_overlap(words, rare), held).otherwise(F.array().cast("array<struct<block:bigint,held:array<string>>>"))


def _read(docs: DataFrame, id: str, text: str, known: _Templates) -> DataFrame:
    key = hash128(F.col(P + "text"), F.col(quoted(id)).cast("string"))
    read = _split(docs, [id], text).select(F.col(quoted(id)).alias("id"), key.alias("key"), F.size(P + "words").cast("bigint").alias("n_words"), _places().alias("places"), known.blocks().alias("blocks"))
    return written(read, "words")


def _joined(rows: DataFrame, known: _Templates) -> DataFrame:
    """(id, key, block, template, label, containment) of all blocks and templates that match."""
    block = rows.where(F.size("blocks") > 0).select("id", "key", F.explode("blocks").alias("b")).select("id", "key", "b.*")
    token = block.select("id", "key", "block", "held", F.posexplode("held").alias("j", "w"))
    n = F.size("held")
    passes = (n >= F.col("need")) & (F.col("j") <= n - F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, n - F.col("j") - 1) >= F.col("need"))
    pairs = token.join(known.prefixes(rows.sparkSession), "w").where(passes)
    common = F.size(F.array_intersect("held", "own"))
    # a pair may meet in several prefix words: its first common one counts
    return pairs.where(common >= F.col("need")).groupBy("id", "key", "block", "template", "label").agg(F.max(common / F.col("size")).alias("containment"))


def matches(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Every text block that meets the threshold of a template: id, block, first_word and last_word (exclusive, as far as the text goes), template number, label, containment."""
    known = _Templates(docs, text, threshold, templates)
    rows = _read(docs, id, text, known)
    found = _joined(rows, known).join(rows.select("key", "n_words").distinct(), "key")
    begin = F.col("block") * known.stride
    return found.select(F.col("id").alias(id), "block", begin.alias("first_word"), F.least(begin + 2 * known.stride, F.col("n_words")).alias("last_word"), "template", "label", "containment")


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the greatest containment)."""
    known = _Templates(docs, text, threshold, templates)
    rows = _read(docs, id, text, known)
    labels = _joined(rows, known).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("part"))

    starts = F.transform("places", lambda p: p["at"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    some = F.size("places") > 0
    return rows.join(labels, "key", "left").select(
        F.col("id").alias(id), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(some, 1.0).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )
