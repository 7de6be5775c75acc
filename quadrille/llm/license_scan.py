"""License notices by an exact set-similarity join, in built-in functions only.

A text block is what stands together from a line on: the line itself and, while lines are hard-wrapped (at most
``WRAPPED`` characters), the next, up to ``LINES`` lines and never past a line without words. So a notice is met whole,
on one line or wrapped, wherever it begins. A block's tokens are its lower-cased words of digits, letters and all
characters beyond ASCII. It matches a template if it contains at least ``containment`` of the template's distinct
tokens. Tokens that no template has can't add to an overlap, so they are left out at once; the others
are ordered by how many blocks hold them, rarest first. With ``need = ceil(containment * size)``:

* length: a block with fewer than ``need`` such tokens can't match;
* prefix: a match shares a token among the template's first ``size - need + 1`` that is also within
  the block's first ``len - need + 1``;
* position: with a shared token at places i and j (from 0), the overlap is at most
  ``min(i, j) + 1 + min(size - 1 - i, len - 1 - j)``.

What is left is verified by the whole intersection. The texts are read and split once: what each row keeps of
them, its counts and the blocks that are long enough for any template, is written, and token counts and join read
that. Templates are few and fixed in the code, so their postings are literals of the plan; the frequency table has a row
per template token at most.

Edge cases: a null text is empty and has no labels, score 0 and null places; a very long text has as many blocks as
lines; templates that tie all give their labels; each row is judged by itself, so rows that share an id, or have
none, get their own results; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc0", "dedicated to the public domain under creative commons zero cc0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose is hereby granted"),
    ("proprietary", "all rights reserved no part may be reproduced without written permission"),
]
TEMPLATES += [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
]
CONTAINMENT = 0.9
WRAPPED, LINES = 120, 10


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def lowered(text: Column) -> Column:
    """Only A to Z change, as in the contract; other letters stay."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOW)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def _templates(templates, containment: float):
    out = []
    for label, text in templates:
        words = list(dict.fromkeys(w for w in re.split(NOT_WORD, text.lower()) if w))
        out.append((label, words, math.ceil(containment * len(words) - 1e-9)))
    return out


def _blocks(low: Column, vocabulary: list[str], least: int) -> Column:
    """The distinct template tokens of the block from each line on, where there are enough for any match."""
    lines = F.transform(
        F.split(low, "\n", -1),
        lambda x: F.struct(
            F.array_distinct(F.filter(F.split(x, NOT_WORD), lambda w: w.isin(vocabulary))).alias("t"),
            x.rlike(WORD).alias("any"),
            (F.length(x) <= WRAPPED).alias("goes_on"),
        ),
    )

    def more(s: Column, x: Column) -> Column:
        on = s["goes_on"] & x["any"]
        return F.struct(F.when(on, F.array_union(s["t"], x["t"])).otherwise(s["t"]).alias("t"), (on & x["goes_on"]).alias("goes_on"))

    def from_line(of: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("t"), F.lit(True).alias("goes_on"))
        return F.transform(of, lambda _, k: F.aggregate(F.slice(of, k + 1, LINES), start, more, lambda s: s["t"]))

    return F.array_distinct(F.filter(let(lines, from_line), lambda b: F.size(b) >= least))


def matches(rows: DataFrame, parsed, vocabulary: list[str]) -> DataFrame:
    """(row, label, containment) of every block and template that match; ``rows`` has (row, blocks)."""
    blocks = rows.select("row", F.explode("blocks").alias("block"))
    counted = blocks.select(F.explode("block").alias("token")).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counted.collect()}  # at most one row for each template token
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    postings = []
    for t, (label, words, need) in enumerate(parsed):
        ranks = sorted(rank[w] for w in words)
        postings += [(t, label, need, ranks, i, r) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    spark = rows.sparkSession
    index = spark.createDataFrame(postings, "template int, label string, need int, ranks array<int>, i int, rank int")
    ranked = blocks.where(F.arrays_overlap("block", F.array(*[F.lit(order[r]) for r in sorted({p[5] for p in postings})])))
    to_rank = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])
    ranked = ranked.select("row", F.array_sort(F.transform("block", lambda w: F.element_at(to_rank, w))).alias("block"))
    prefix = ranked.select("row", "block", F.posexplode("block").alias("j", "rank"))
    near = prefix.join(F.broadcast(index), "rank").where(
        (F.size("block") >= F.col("need"))
        & (F.col("j") <= F.size("block") - F.col("need"))
        & (F.least("i", "j") + 1 + F.least(F.size("ranks") - 1 - F.col("i"), F.size("block") - 1 - F.col("j")) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("block", "ranks"))
    return near.where(overlap >= F.col("need")).select("row", "label", (overlap / F.size("ranks")).alias("containment"))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def phrase_places(words: Column, phrases=tuple(PHRASES)) -> Column:
    """Struct of (n, first, last, found) over the places where a phrase's words stand consecutively."""

    def over(t: Column) -> Column:
        parts = []
        for p in phrases:
            own = p.split()
            text = " " + "  ".join(own) + " "
            n = ((F.length(t) - F.length(F.replace(t, F.lit(text), F.lit("")))) / len(text)).cast("long")
            first = (_spaces(F.substring_index(t, text, 1)) / 2).cast("long")
            after = (_spaces(F.substring_index(t, text, -1)) / 2).cast("long")
            last = (_spaces(t) / 2).cast("long") - after - len(own)
            parts.append(F.struct(n.alias("n"), F.when(n > 0, first).alias("first"), F.when(n > 0, last).alias("last"), F.when(n > 0, F.lit(PHRASES.get(p, p))).alias("label")))
        return let(
            F.array(*parts),
            lambda a: F.struct(
                F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"),
                F.array_min(F.transform(a, lambda x: x["first"])).alias("first"),
                F.array_max(F.transform(a, lambda x: x["last"])).alias("last"),
                F.filter(F.transform(a, lambda x: x["label"]), lambda x: x.isNotNull()).alias("found"),
            ),
        )

    return let(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), over)


def license_scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Per row of ``docs``: word count, phrase places and labels, and the join's labels with its best containment."""
    parsed = _templates(templates, containment)
    vocabulary = sorted({w for _, words, _ in parsed for w in words})
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("found"))
    words = tokens(F.col("_t"))
    rows = docs.select("doc_id", lowered(F.col("text")).alias("_t")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.when(F.col("_t").rlike("license|cc[^0-9a-z]"), phrase_places(words)).otherwise(nothing).alias("b"),
        _blocks(F.col("_t"), vocabulary, min(need for *_, need in parsed)).alias("blocks"),
    )
    rows = written(rows, "blocks")
    own = matches(rows, parsed, vocabulary).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("containment").alias("score"))
    labels = F.array_sort(F.array_union("b.found", F.coalesce("own", F.array().cast("array<string>"))))
    return rows.drop("blocks").join(own, "row", "left").select(
        "doc_id",
        "n_words",
        F.col("b.n").alias("n_base"),
        F.col("b.first").alias("first_word"),
        F.col("b.last").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("b.found")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle_sql(table: str = "documents", templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same for DuckDB, comparing every block with every template in full. Blocks of lines are found by
    counting the blank and the long lines before each."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOW}')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(f"('{label}', {words!r}, {need})" for label, words, need in _templates(templates, containment))
    known = ", ".join(f"'{w}'" for w in sorted({w for _, words, _ in _templates(templates, containment) for w in words}))
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM w WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items()
    )
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS w, string_split({low}, chr(10)) AS lines FROM {table}),
w AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license') OR list_contains(w, 'cc')),
p AS ({places}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS found FROM p GROUP BY doc_id),
t(label, words, need) AS (VALUES {rows}),
s AS (SELECT doc_id, i, regexp_extract_all(lines[i], '{word}') AS t, length(lines[i]) > {WRAPPED} AS long FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
r AS (SELECT doc_id, i, list_filter(list_distinct(t), lambda x: x IN ({known})) AS t, len(t) AS any_, sum((len(t) = 0)::INT) OVER w AS blank, sum(long::INT) OVER w - long::INT AS long FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l AS (SELECT x.doc_id, x.i, list_distinct(flatten(list(y.t))) AS block FROM r x JOIN r y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i AND x.i + {LINES - 1} AND y.blank = x.blank AND y.long = x.long AND y.any_ > 0
      WHERE x.any_ > 0 GROUP BY x.doc_id, x.i),
m AS (SELECT doc_id, list(DISTINCT label) AS own, max(len(list_intersect(block, words))::DOUBLE / len(words)) AS score
      FROM l, t WHERE len(list_intersect(block, words)) >= need GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(own, [])))), ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""
