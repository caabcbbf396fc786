"""License scans over a positional index of rare template words, natively.

A template is a run of words. Where at least a share q of its n words stand in their
places, at least one of its n - ceil(q n) + 1 rarest words does too; so only those are
indexed, as postings of (template, offset) by word. Each such word of a file is looked
up; its place less the offset is where the template would start. Places named by any
posting are tried once: the template's words are compared at their relative positions,
and a mandatory key phrase must stand there whole.

Templates and postings are two constant tables inside the plan, which has the same
expressions however many templates there are. Rarity is counted over all documents.
Everything runs on one array of words a row: no shuffle but the counts of the template
words.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.url_filter import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """words must match by share; those at key (first, beyond last) all of them."""

    label: str
    text: str
    share: float = 1.0
    key: tuple[int, int] = (0, 0)
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, LOWER)))

    @property
    def least(self) -> int:
        return math.ceil(self.share * len(self.words))


# Wordings of public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met"""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED."""
BSD_NAMES = """may be used to endorse or promote products derived from this software without specific prior written
permission"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions"""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at"""
APACHE_WARRANTY = """Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""
LGPL_NOTICE = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation"""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at"""

#: Fixed values of the contract, then the method's own templates: short runs, and texts in full.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("apache-notice", "licensed under the apache license version 2 0", 0.85, (3, 5)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.8, (0, 3)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", 0.8, (3, 6)),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation", 0.8, (5, 7)),
    Template("lgpl", "gnu lesser general public license", 0.8, (0, 2)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.8, (0, 4)),
    Template("mpl", "subject to the terms of the mozilla public license", 0.75, (6, 9)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.8, (4, 6)),
    Template("mit", MIT, 0.9, (0, 4)),
    Template("isc", ISC, 0.85, (0, 4)),
    Template("bsd", BSD_CONDITIONS, 0.85, (0, 3)),
    Template("bsd", BSD_DISCLAIMER, 0.85, (0, 4)),
    Template("bsd-3-clause", BSD_NAMES, 0.9, (4, 8)),
    Template("zlib", ZLIB, 0.85, (0, 5)),
    Template("unlicense", UNLICENSE, 0.85, (4, 6)),
    Template("apache-notice", APACHE_NOTICE, 0.85, (3, 5)),
    Template("apache-notice", APACHE_WARRANTY, 0.85, (0, 5)),
    Template("gpl", GPL_NOTICE, 0.85, (18, 22)),
    Template("lgpl", LGPL_NOTICE, 0.85, (18, 20)),
    Template("mpl", MPL_NOTICE, 0.85, (11, 14)),
)


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(folded, F.lit(WORD), 0)


def document_frequencies(docs: DataFrame, text: str, templates: Sequence[Template]) -> dict[str, int]:
    """Documents that hold each template word; as many numbers as there are such words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = words_of(F.col(text))
    held = F.array_intersect(words, F.from_json(F.lit(json.dumps(vocabulary)), "array<string>"))
    counted = docs.select(F.explode(held).alias("w")).groupBy("w").count()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in counted.collect()}


def anchors(t: Template, df: Mapping[str, int]) -> list[tuple[str, int]]:
    """(word, offset) of the rarest words, one of which any match must hold in place."""
    ranked = sorted(enumerate(t.words), key=lambda x: (df.get(x[1], 0), x[1], x[0]))
    return [(w, i) for i, w in ranked[: len(t.words) - t.least + 1]]


TABLE = "array<struct<words: array<string>, least: int, first: int, beyond: int, label: string, base: boolean>>"
POSTINGS = "map<string, array<struct<template: int, offset: int>>>"


def template_table(templates: Sequence[Template]) -> Column:
    """All templates as one constant array, at their numbers."""
    rows = [
        {"words": t.words, "least": t.least, "first": t.key[0], "beyond": t.key[1], "label": t.label, "base": t.base}
        for t in templates
    ]
    return F.from_json(F.lit(json.dumps(rows)), TABLE)


def postings(templates: Sequence[Template], df: Mapping[str, int]) -> dict[str, list[dict[str, int]]]:
    """Templates and offsets by anchor word."""
    out: dict[str, list[dict[str, int]]] = {}
    for k, t in enumerate(templates):
        for word, offset in anchors(t, df):
            out.setdefault(word, []).append({"template": k, "offset": offset})
    return out


def places(words: Column, hits: Column, table: Column, index: Column) -> Column:
    """Array of (template, start, matched, of) of all templates, from the hits of their anchors."""
    named = F.transform(
        hits,
        lambda i: F.transform(
            F.element_at(index, F.get(words, i)),
            lambda p: F.struct(p["template"].alias("template"), (i - p["offset"]).alias("start")),
        ),
    )
    run = lambda a, b: F.sequence(a, b - 1)

    def tried(c: Column) -> Column:
        t = F.get(table, c["template"])
        n = F.size(t["words"])
        same = F.filter(run(F.lit(0), n), lambda k: F.get(words, c["start"] + k) == F.get(t["words"], k))
        key = (t["beyond"] <= t["first"]) | F.forall(
            F.when(t["beyond"] > t["first"], run(t["first"], t["beyond"])).otherwise(F.array().cast("array<int>")),
            lambda k: F.coalesce(F.get(words, c["start"] + k) == F.get(t["words"], k), F.lit(False)),
        )
        matched = F.when(key, F.size(same)).otherwise(0)
        return F.struct(c["template"].alias("template"), c["start"].alias("start"), matched.alias("matched"), n.alias("of"))

    compared = F.transform(F.array_distinct(F.flatten(named)), tried)
    return F.filter(compared, lambda c: c["matched"] >= F.get(table, c["template"])["least"])


def scan(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score to docs.

    n_base counts every place of every base template, first_word and last_word are
    the smallest and largest start among them (null without any). labels holds base
    labels and those of the other templates; score is the largest share of words in
    place, 1 for a base place, 0 without any. Null and empty texts have no words, no
    labels ('') and score 0; repeated rows are scanned alike; columns of docs with one
    of the new names are replaced.
    """
    df = document_frequencies(docs, text, templates)
    by_word = postings(templates, df)
    table, index = template_table(templates), F.from_json(F.lit(json.dumps(by_word)), POSTINGS)
    words, found = F.col("__words"), F.col("__found")
    out = docs.withColumn("__words", words_of(F.col(text)))
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("__hits", F.filter(every, lambda i: F.get(words, i).isin(sorted(by_word))))
    out = out.withColumn("__found", places(words, F.col("__hits"), table, index))
    field = lambda c, name: F.get(table, c["template"])[name]
    starts = F.transform(F.filter(found, lambda c: field(c, "base")), lambda c: c["start"])
    named = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda c: field(c, "label")))), ",")
    best = F.array_max(F.transform(found, lambda c: c["matched"] / c["of"]))
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_base": F.size(starts).cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
            "base_labels": named(F.filter(found, lambda c: field(c, "base"))),
            "labels": named(found),
            "score": F.coalesce(best, F.lit(0.0)),
        }
    )
    return out.drop("__words", "__hits", "__found")


def contract_sql() -> str:
    """The same scan in SQL: every word of every template meets every place that holds it."""
    rows = ", ".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {t.least}, {max(0, t.key[1] - t.key[0])})" for k, t in enumerate(TEMPLATES)
    )
    words = ", ".join(
        f"({k}, {o}, '{w}', {int(t.key[0] <= o < t.key[1])})" for k, t in enumerate(TEMPLATES) for o, w in enumerate(t.words)
    )
    labels = "coalesce(string_agg(DISTINCT label, ',' ORDER BY label){}, '')"
    return f"""
WITH templates(t, label, base, of, least, key) AS (VALUES {rows}),
postings(t, o, word, in_key) AS (VALUES {words}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
counted AS (SELECT r, t, i - o AS start, count(*) AS matched, sum(in_key) AS keyed FROM held JOIN postings USING (word) GROUP BY r, t, i - o),
found AS (SELECT r, label, base, start, matched::DOUBLE / of AS share FROM counted JOIN templates USING (t) WHERE matched >= least AND keyed = key),
told AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    {labels.format(" FILTER (WHERE base)")} AS base_labels, {labels.format("")} AS labels, max(share) AS score
  FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN told USING (r)"""
