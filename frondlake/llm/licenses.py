"""License scan: exact phrases, and an exact set-similarity join of text blocks with license templates.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing
A-Z. A block is any window of ``BLOCK`` words, wherever it begins. It meets a
template if it contains at least ``threshold`` of the template's distinct words.
A window that meets a template contains as many of its words as the window that
begins at the first of them, so looking at the windows that begin at a template word
(a hit) finds every label and the best score; these windows are what is reported.

The join is exact and filters first:

* template words are ordered by their document frequency over all documents,
  rarest first (``word_order``, one aggregate over the template vocabulary);
* *prefix filter*: with ``need`` words required out of ``n``, one of the template's
  ``n - need + 1`` rarest words must be in the text, or none of its windows is looked
  at; the same then holds for each window;
* *length filter*: ``need - 1`` further hits must stand within ``BLOCK`` words of the
  first, which is looked up by place in the list of hits;
* *positional filter*: after the first shared word, in the order of the words, the
  words left on the shorter side must suffice;
* what remains is verified by counting the overlap.

Templates are the bounded side and travel inside the plan; documents are neither
shuffled nor joined, so hot sources and repeated texts cost nothing extra. Only
built-in functions are used.

Rows: null text counts as empty: no words, null positions, no labels, score 0.
Repeated rows are scanned row by row, and very long texts whole: the work on a text is
linear in its words. Other columns pass unchanged unless a result column has their
name. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import free_names
from .quality import bind

BLOCK = 64
THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# -- fixed values: phrases of the contract and their labels ------------------------
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# -- notices of public licenses, in words: one template for each sentence they are known by -------
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited "
            "to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability "
            "whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the "
                 "license at www apache org licenses"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is "
                 "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
            "following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied "
            "warranties including but not limited to the implied warranties of merchantability and fitness for a "
            "particular purpose are disclaimed"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the "
            "implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
             "lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
              "mpl was not distributed with this file"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software "
            "including all implied warranties of merchantability and fitness"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy "
                  "modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or "
                            "transmitted in any form or by any means without the prior written permission of the "
                            "publisher"),
)

RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def word_text(text: Column | str) -> Column:
    """The words of a text, joined and enclosed by single spaces."""
    text = F.col(text) if isinstance(text, str) else text
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), SEPARATORS, " ")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def vocabulary(templates: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({word for _, text in templates for word in text.split()})


def word_order(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text") -> list[str]:
    """Template words, rarest first by document frequency (ties by word). One row per template word is collected."""
    words = vocabulary(templates)
    seen = docs.select(F.array_distinct(F.filter(F.split(word_text(text), " "), lambda w: w.isin(words))).alias("w"))
    counted = seen.select(F.explode("w").alias("w")).groupBy("w").count().collect()
    frequency = {r["w"]: r["count"] for r in counted}
    return sorted(words, key=lambda w: (frequency.get(w, 0), w))


def _prepared(templates: Sequence[tuple[str, str]], order: list[str], threshold: float) -> list[tuple]:
    """(label, words in global order, number of words needed) of each template."""
    rank = {word: i for i, word in enumerate(order)}
    out = []
    for label, text in templates:
        words = sorted(set(text.split()), key=rank.__getitem__)
        out.append((label, words, math.ceil(threshold * len(words) - 1e-9)))
    return out


def _overlap(block: Column, words: list[str], need: int) -> Column:
    """Number of shared words, or null if a filter proves that it is below ``need``."""
    have, n = F.size(block), len(words)
    prefix = _strings(words[:n - need + 1])
    shared = F.array_intersect(F.slice(block, F.lit(1), F.greatest(have - need + 1, F.lit(0))), prefix)
    first = F.get(shared, F.lit(0))
    left = F.least(have - F.array_position(block, first), n - F.array_position(_strings(words), first)) + 1
    count = F.size(F.array_intersect(block, _strings(words)))
    return F.when(have < need, None).when(F.size(shared) == 0, None).when(left < need, None).when(
        count >= need, count)


def _windows(hits: Column, label: str, words: list[str], need: int, block: int) -> Column:
    """Windows that begin at a word of the template and meet it, from all ``hits`` (at, word) of a text."""
    def windows(own: Column) -> Column:
        def window(i: Column) -> Column:
            start = F.get(own, i)["at"]
            near = F.filter(F.slice(own, i + 1, F.lit(block)), lambda h: h["at"] < start + block)
            held = F.array_intersect(_strings(words), F.transform(near, lambda h: h["word"]))
            return F.struct(F.lit(label).alias("label"), start.cast("long").alias("first_word"),
                            bind(held, lambda b: _overlap(b, words, need) / F.lit(float(len(words)))).alias("score"))

        starts = F.filter(F.sequence(F.lit(0), F.size(own) - need), lambda i: (
            F.get(own, i + need - 1)["at"] < F.get(own, i)["at"] + block))
        return F.when(F.size(own) >= need, F.filter(F.transform(starts, window), lambda m: m["score"].isNotNull()))

    rarest = F.exists(hits, lambda h: h["word"].isin(words[:len(words) - need + 1]))
    own = F.filter(hits, lambda h: h["word"].isin(words))
    none = F.array().cast("array<struct<label:string,first_word:bigint,score:double>>")
    return F.coalesce(F.when(rarest, bind(own, windows)), none)


def scan(docs: DataFrame, order: list[str] | None = None, text: str = "text",
         phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Add ``RESULT`` and ``blocks``, an array of (label, first_word, score): the blocks that begin at a template word.

    ``order`` may be given to share one ``word_order`` among scans; any order gives the same result.
    """
    order = order or word_order(docs, templates, text)
    ready = _prepared(templates, order, threshold)
    rare = sorted({word for _, words, need in ready for word in words[:len(words) - need + 1]})
    kept = [c for c in docs.columns if c not in RESULT + ("blocks",)]
    joined, split, at, hits = free_names([*docs.columns, *RESULT, "blocks"], "joined", "split", "at", "hits")
    rows = docs.select(*kept, word_text(text).alias(joined))
    rows = rows.withColumn(split, F.array_remove(F.split(joined, " "), ""))

    def places(phrase: str, label: str) -> Column:
        size = phrase.count(" ") + 1
        starts = F.filter(F.sequence(F.lit(1), F.size(split) - size + 1),
                          lambda i: F.slice(split, i, F.lit(size)) == _strings(phrase.split()))
        return F.when(F.col(joined).contains(f" {phrase} "), F.transform(
            starts, lambda i: F.struct((i - 1).cast("long").alias("at"), F.lit(label).alias("label")))).otherwise(
            F.array().cast("array<struct<at:bigint,label:string>>"))

    known = F.filter(F.transform(split, lambda w, i: F.struct(i.alias("at"), w.alias("word"))),
                     lambda h: h["word"].isin(order))
    rows = rows.withColumn(at, F.concat(*[places(p, label) for p, label in phrases]))
    rows = rows.withColumn(hits, F.when(F.exists(split, lambda w: w.isin(rare)), known).otherwise(
        F.array().cast("array<struct<at:int,word:string>>")))
    rows = rows.withColumn("blocks", F.concat(*[_windows(F.col(hits), *template, block) for template in ready]))
    labels = F.transform(at, lambda p: p.label)
    found = F.concat(labels, F.transform("blocks", lambda b: b.label))
    best = F.array_max(F.transform("blocks", lambda b: b.score))
    return rows.select(
        *kept, F.size(split).cast("long").alias("n_words"), F.size(at).cast("long").alias("n_base"),
        F.array_min(F.transform(at, lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform(at, lambda p: p["at"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("labels"),
        F.when(F.size(at) > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"), "blocks")


def sql(documents: str = "documents") -> str:
    """Plain SQL of the scan: the distinct template words in the window that begins at each word, no filters."""
    templates = ", ".join(f"({i}, '{label}', {sorted(set(text.split()))})" for i, (label, text) in enumerate(TEMPLATES))
    places = " UNION ALL ".join(
        f"SELECT r, i - 1 AS place, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) - {phrase.count(' ') - 1}))"
        f" AS i FROM words) WHERE w[i:i + {phrase.count(' ')}] = {phrase.split()}" for phrase, label in PHRASES)
    return f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {documents}),
places AS ({places}),
base AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
templates(k, label, t) AS (VALUES {templates}),
wanted AS (SELECT k, unnest(t) AS word FROM templates),
placed AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM words),
counted AS (SELECT r, k, count(DISTINCT word) OVER (PARTITION BY r, k ORDER BY i
  RANGE BETWEEN CURRENT ROW AND {BLOCK - 1} FOLLOWING) AS n FROM placed JOIN wanted USING (word)),
matches AS (SELECT r, label, n, len(t) AS size FROM counted JOIN templates USING (k)
  WHERE n >= ceil({THRESHOLD} * len(t) - 1e-9)),
found AS (SELECT r, max(n / size::DOUBLE) AS score FROM matches GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM places UNION SELECT r, label FROM matches) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (r) LEFT JOIN found USING (r) LEFT JOIN every USING (r)"""

