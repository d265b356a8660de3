"""License scans: phrases in place, and an exact set-similarity join of text blocks with notice templates.

A template is a notice, seen as its set of words. A window is a run of consecutive words of a text, a quarter longer than the
template and across whatever line ends there are; the template is found where a window holds at least ``threshold`` of its
words. Texts are cut into blocks that overlap by the longest window, so every window lies in one. Words of templates are ordered
by how many documents hold them, rarest first, over the whole corpus. A block with such a window must hold a word of the
template's prefix (prefix filter), enough template words at all (length filter) and, from its first prefix word on, enough words
on both sides (positional filter); in what is left, every window that begins with a template word is counted exactly. The
templates are a fixed short table, so the join needs no shuffle: each row probes them where it is. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Words after A-Z are lower-cased: digits, a-z and everything beyond ASCII. Written as what is in the class: Java's regex
#: engine takes seven times as long for the complement of several ranges.
TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"

#: Phrases and labels that the contract fixes.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices in common use, as their licenses word them, and the label that each stands for.
TEMPLATES = (
    ("released under the MIT License", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.", "mit",
    ),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache-2",
    ),
    ("you may not use this file except in compliance with the License", "apache-2"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide. This software is distributed without any warranty.", "cc0",
    ),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3",
    ),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl",
    ),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.", "isc",
    ),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)

THRESHOLD = 0.9


def notice(text: str) -> list[str]:
    """The words of a template in order."""
    return re.findall(r"[0-9a-z]+", text.lower())


def least_words(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def window(n: int) -> int:
    """Words of a window for a template of n words: a quarter more than it has."""
    return n + n // 4


def tokens(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def literal(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def ranked_vocabulary(docs: DataFrame, text_col: str, templates) -> list[str]:
    """Every word of the templates, by the number of documents that hold it (rarest first, ties by word).

    Counted over all documents; what comes to the driver is one number for each word of the fixed templates.
    """
    vocabulary = sorted({w for t, _ in templates for w in notice(t)})
    counts = docs.select(F.explode(F.array_intersect(literal(vocabulary), tokens(F.col(text_col)))).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def places(words: Column, phrase: str) -> Column:
    """Indices at which the phrase's words stand one after the other."""
    parts = phrase.split()
    starts = F.when(
        F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1]) & (F.size(words) >= len(parts)),
        F.filter(
            F.sequence(F.lit(0), F.size(words) - len(parts)),
            lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)]),
        ),
    )
    return F.coalesce(starts, F.array().cast("array<int>"))


def table(order: list[str], templates, threshold: float) -> Column:
    """The templates as an array of rows: words in the global order, prefix, how many words are enough, words, window."""
    rank = {w: k for k, w in enumerate(order)}

    def row(text: str) -> Column:
        own = notice(text)
        words = sorted(set(own), key=rank.__getitem__)
        least = least_words(len(words), threshold)
        named = {"words": literal(words), "prefix": literal(words[: len(words) - least + 1]), "least": F.lit(least), "n": F.lit(len(words)), "window": F.lit(window(len(own)))}
        return F.struct(*[v.alias(k) for k, v in named.items()])

    return F.array(*[row(t) for t, _ in templates])


def may_hold(b: Column, t: Column) -> Column:
    """Prefix, length and positional filter of a block (v: its template words in the global order) and a template."""
    first = F.get(F.array_intersect(t["prefix"], b["v"]), F.lit(0))
    # words from the first shared prefix word on, on either side
    bound = F.least(t["n"] - F.array_position(t["words"], first), F.size(b["v"]) - F.array_position(b["v"], first)) + 1
    return (F.size(b["v"]) >= t["least"]) & F.arrays_overlap(b["v"], t["prefix"]) & (bound >= t["least"])


def most_held(b: Column, t: Column) -> Column:
    """The most words of a template that a window of a block (b: its words) holds; it may as well begin with one of them."""
    starts = F.filter(F.sequence(F.lit(0), F.size(b["b"]) - 1), lambda i: F.array_contains(t["words"], F.get(b["b"], i)))
    return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(t["words"], F.slice(b["b"], i + 1, t["window"])))))


def scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Null and empty texts have no words, no labels ('') and score 0. Texts and lines of any length are taken whole, in blocks.
    score: 1 where a phrase stands, else the largest template containment that meets the threshold, else 0; of templates that tie,
    all labels are given. Repeated rows get equal results. Columns of ``docs`` with the names of results are replaced.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    docs = docs.drop(*names)
    order = ranked_vocabulary(docs, text_col, templates)
    rank = {w: k for k, w in enumerate(order)}
    rare = set()
    for t, _ in templates:
        own = sorted(set(notice(t)), key=rank.__getitem__)
        rare |= set(own[: len(own) - least_words(len(own), threshold) + 1])
    rare = literal(sorted(rare, key=rank.__getitem__))
    hop = max((window(len(notice(t))) for t, _ in templates), default=1)
    words = F.col("_lic_words")
    found = [places(words, p) for p in phrases]
    cut = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(hop)), lambda at: F.slice(words, at + 1, 2 * hop))
    cut = F.transform(F.filter(cut, lambda b: F.arrays_overlap(b, rare)), lambda b: F.struct(F.array_intersect(literal(order), b).alias("v"), b.alias("b")))
    blocks = F.when(F.arrays_overlap(words, rare), cut)  # null, not false, where there are no words
    out = docs.withColumn("_lic_words", tokens(F.col(text_col)))
    out = out.select(*docs.columns, F.size("_lic_words").cast("long").alias("n_words"), F.array(*found).alias("_lic_at"), blocks.alias("_lic_blocks"))

    def part(t: Column) -> Column:
        most = F.array_max(F.transform(F.filter("_lic_blocks", lambda b: may_hold(b, t)), lambda b: most_held(b, t)))
        return F.when(most >= t["least"], most / t["n"].cast("double")).otherwise(0.0)

    parts = F.when(F.size(F.coalesce("_lic_blocks", F.array())) > 0, F.transform(table(order, templates, threshold), part)) if templates else F.lit(None)
    out = out.withColumn("_lic_part", F.coalesce(parts, F.array().cast("array<double>")))
    at = F.flatten("_lic_at")
    base = F.array_compact(F.array(*[F.when(F.size(F.col("_lic_at")[k]) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    more = F.array_compact(F.array(*[F.when(F.get(F.col("_lic_part"), F.lit(k)) > 0, F.lit(label)) for k, (_, label) in enumerate(templates)]))
    join = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    return out.select(
        *docs.columns, "n_words", F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, more)).alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(F.coalesce(F.array_max("_lic_part"), F.lit(0.0))).alias("score"),
    )


def license_digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text")


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> str:
    """DuckDB SQL for ``license_digest``, without filters: every word of a template counts for the windows that end from where it
    stands to before it stands again or has left them; running sums tell how many are in each window."""
    q = lambda s: "'" + s + "'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    base = ", ".join(
        f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: " + " AND ".join(f"w[i + {k + 1}] = {q(x)}" for k, x in enumerate(p.split())) + f") AS p{n}"
        for n, p in enumerate(phrases)
    )
    own = [notice(t) for t, _ in templates]
    kinds = ", ".join(f"({k}, {len(set(t))}, {least_words(len(set(t)), threshold)}, {window(len(t))}, {q(templates[k][1])})" for k, t in enumerate(own))
    words = ", ".join(f"({k}, {q(w)})" for k, t in enumerate(own) for w in dict.fromkeys(t))
    at = " || ".join(f"p{n}" for n in range(len(phrases)))
    labels = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN {q(x)} END" for n, x in enumerate(phrases.values()))
    joined = lambda items: f"array_to_string(list_sort(list_distinct(list_filter({items}, lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH a AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, {pattern}) AS w FROM documents),
kinds(t, n, least, width, label) AS (VALUES {kinds}), words(t, x) AS (VALUES {words}),
tok AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM a),
occ AS (SELECT rid, t, p, lead(p) OVER (PARTITION BY rid, t, x ORDER BY p) AS again FROM tok JOIN words USING (x)),
turns AS (SELECT rid, t, p AS e, 1 AS d FROM occ UNION ALL SELECT rid, t, least(p + width, coalesce(again, p + width)), -1 FROM occ JOIN kinds USING (t)),
sums AS (SELECT rid, t, sum(d) OVER (PARTITION BY rid, t ORDER BY e) AS c FROM (SELECT rid, t, e, sum(d) AS d FROM turns GROUP BY 1, 2, 3)),
best AS (SELECT rid, t, max(c) AS c FROM sums GROUP BY 1, 2),
hits AS (SELECT rid, list(label) AS more, max(c::DOUBLE / n) AS part FROM best JOIN kinds USING (t) WHERE c >= least GROUP BY 1),
f AS (SELECT rid, doc_id, len(w) AS n, {base} FROM a)
SELECT doc_id, n::BIGINT AS n_words, len({at})::BIGINT AS n_base, list_min({at})::BIGINT AS first_word, list_max({at})::BIGINT AS last_word,
  {joined(f"[{labels}]")} AS base_labels, {joined(f"[{labels}] || coalesce(more, [])")} AS labels,
  CASE WHEN len({at}) > 0 THEN 1.0 ELSE coalesce(part, 0.0) END::DOUBLE AS score
FROM f LEFT JOIN hits USING (rid)"""
