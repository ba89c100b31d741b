"""Licence scan: lines, whole texts and windows of words against licence templates by Dice coefficient, in DataFrame operations only."""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.columns import whole_text
from quirespark.llm.shared import written

#: Licence notices by identifier, several wordings each.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Whole licence texts, by identifier. Only windows are compared with them.
TEXTS: list[tuple[str, str]] = [(f.stem, f.read_text("utf-8")) for f in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]
#: Least Dice coefficient, in hundredths.
LEAST = 80
#: Bigrams of a template up to which its necessary words are searched for; those of whole licence texts are too many.
SHORT = 60


def normal_words(text: Column) -> Column:
    """The ASCII letters and digits of a text as lower-case words."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def neighbours(words: Column) -> Column:
    """Pairs of neighbouring words."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(neighbours(words))


def notice_bigrams(notice: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", notice.lower()).split()
    return list(dict.fromkeys(f"{x} {y}" for x, y in zip(words, words[1:], strict=False)))


def necessary(grams: list[str], least: int = LEAST) -> list[str]:
    """Words and bigrams of a template one of which any matching unit holds: a match shares least / (200 - least) of the
    template's bigrams, so it has one of any set that covers more than the rest. Words of four letters or more first, the
    longest before others, as they are rare; then single bigrams."""
    words = sorted({w for g in grams for w in g.split() if len(w) > 3}, key=lambda w: (-len(w), w))
    found: list[str] = []
    covered: set[str] = set()
    for part in words + sorted(grams, key=lambda g: (-len(g), g)):
        if (len(grams) - len(covered)) * (200 - least) < len(grams) * least:
            break
        new = {part} if " " in part else {g for g in grams if part in g.split()}
        if new - covered:
            found.append(part)
            covered |= new
    return found


def may_hold(text: Column, parts: list[str]) -> Column:
    """Whether a text in lower case holds one of some words or bigrams, by substring; parts that hold others are left out."""
    words = {x for x in parts if " " not in x}
    tests = [F.contains(text, F.lit(w)) for w in sorted(words) if not any(x in w and x != w for x in words)]
    tests += [text.rlike(x.replace(" ", "[^a-z0-9]+")) for x in sorted(set(parts) - words) if not any(w in x for w in words)]
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def weighed_words(grams: list[str], known: set[str], hundredths: int) -> dict[str, int]:
    """Words of five letters or more that cover so many hundredths of a template's bigrams, with the number of bigrams that
    each is the first to cover: the known ones first, then those that cover most."""
    holders: dict[str, set[str]] = {}
    for g in grams:
        for w in g.split():
            if len(w) > 4:
                holders.setdefault(w, set()).add(g)
    left, found = set(grams), {}
    while holders and (len(grams) - len(left)) * 100 < len(grams) * hundredths:
        word = max(holders, key=lambda w: (w in known and bool(holders[w] & left), len(holders[w] & left), w))
        new = holders.pop(word) & left
        if not new:
            break
        found[word] = len(new)
        left -= new
    return found


def may_hold_long(words: Column, templates: list[list[str]], least: int) -> Column:
    """Whether a text of these words may hold a long template. A match lacks (200 - 2 * least) / (200 - least) of the
    template's bigrams at most, so of words that cover more those that the text lacks cover no more than that. Where words
    do not cover so much, any text may."""
    lacking = lambda n: n * (200 - 2 * least) // (200 - least)
    known: set[str] = set()
    table = []
    for grams in templates:
        covering = weighed_words(grams, known, 60)
        if sum(covering.values()) <= lacking(len(grams)):
            return F.lit(True)
        known |= covering.keys()
        table.append({"room": lacking(len(grams)), "words": [{"word": w, "n": n} for w, n in covering.items()]})
    table = F.from_json(F.lit(json.dumps(table)), "array<struct<room:int,words:array<struct<word:string,n:int>>>>")
    shared = F.array_intersect(words, F.from_json(F.lit(json.dumps(sorted(known))), "array<string>"))
    # most texts have none of the words, which one pass over theirs tells
    missing = lambda own, t: F.aggregate(t["words"], F.lit(0), lambda n, x: n + F.when(F.array_contains(own, x["word"]), 0).otherwise(x["n"]))
    return F.exists(F.array(shared), lambda own: (F.size(own) > 0) & F.exists(table, lambda t: missing(own, t) <= t["room"]))


def long_enough(text: Column, listed: list[tuple[str, list[str]]], least: int) -> Column:
    """Whether a text may hold one of the long templates, by its length and its words."""
    long = [grams for _, grams in listed if len(grams) > SHORT]
    if not long:
        return F.lit(False)
    # a match shares so many bigrams, a word and a space more for each
    return (F.char_length(text) * (200 - least) >= F.lit(2 * min(map(len, long)) * least)) & may_hold_long(normal_words(text), long, least)


def _listed(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return [(licence, grams) for licence, notice in dict.fromkeys(templates) if (grams := notice_bigrams(notice))]


def window_matches(docs: DataFrame, templates: list[tuple[str, str]], least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of a text's words, across line ends, that match a template, as (doc_id, best) with best as of units. No two
    of a text share a word: those of more overlap come first (ties: the larger coefficient, then the later name).

    The bigrams of a text that are also a template's form runs. Windows begin where a run begins and end where one ends,
    as others gain by being stretched or cut to that; they have at most b * (200 - least) / least bigrams, as longer ones
    cannot match. |A| counts the template's bigrams once and others as often as they occur."""
    listed = _listed(templates)
    index = [{"template": k, "licence": licence, "b": len(grams), "gram": g} for k, (licence, grams) in enumerate(listed) for g in grams]
    index = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(index)), "array<struct<template:int,licence:string,b:int,gram:string>>")))
    may = may_hold(F.lower("text"), [x for _, grams in listed if len(grams) <= SHORT for x in necessary(grams, least)])
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    may = may | long_enough(F.col("text"), listed, least)
    kept = rows.filter(may).select("doc_id", F.monotonically_increasing_id().alias("row"), neighbours(normal_words(F.col("text"))).alias("grams"))
    met = kept.select("doc_id", "row", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(index), "gram")
    hits = met.groupBy("doc_id", "row", "template", "licence", "b").agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("hits"))
    near = hits.filter(F.size(F.array_distinct(F.transform("hits", lambda x: x["gram"]))) * (200 - least) >= F.col("b") * least)
    at = F.transform("hits", lambda x: x["pos"])
    near = near.withColumn("at", at).withColumn("starts", F.array_except("at", F.transform("at", lambda x: x + 1))).withColumn("ends", F.array_except("at", F.transform("at", lambda x: x - 1)))
    spans = F.flatten(F.transform("starts", lambda s: F.transform(F.filter("ends", lambda e: (e >= s) & ((e - s + 1) * least <= F.col("b") * (200 - least))), lambda e: F.struct(s.alias("s"), e.alias("e")))))
    spans = near.withColumn("span", F.explode(spans)).select("doc_id", "row", "licence", "b", "span.s", "span.e", "hits")
    own = F.filter("hits", lambda x: (x["pos"] >= F.col("s")) & (x["pos"] <= F.col("e")))
    spans = spans.withColumn("own", own).withColumn("overlap", F.size(F.array_distinct(F.transform("own", lambda x: x["gram"])))).withColumn("total", (F.col("e") - F.col("s") + 1 - F.size("own") + F.col("overlap") + F.col("b")).cast("long"))
    found = spans.filter(F.col("overlap") * 200 >= least * F.col("total")).withColumn("overlap", F.col("overlap").cast("long")).withColumn("dice", 2 * F.col("overlap") / F.col("total"))
    ranked = found.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("overlap", "dice", "licence", "total", "s", "e")), asc=False).alias("ranked"))
    apart = F.aggregate("ranked", F.slice("ranked", 1, 0), lambda taken, x: F.when(F.exists(taken, lambda y: (y["s"] <= x["e"] + 1) & (x["s"] <= y["e"] + 1)), taken).otherwise(F.concat(taken, F.array(x))))
    return ranked.select("doc_id", F.explode(apart).alias("w")).select("doc_id", F.struct("w.dice", "w.overlap", "w.licence", "w.total").alias("best"))


def licence_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence that a unit of it matches best: doc_id, licence, n_units, best_overlap,
    best_total and dice (2 * best_overlap / best_total). Units are the lines of a text and, if it has several, the whole;
    besides, windows of words (see window_matches) find notices that are wrapped or within a line or longer text, and, if
    no templates are given, whole licence texts. n_units is the number of matching units or of windows, whichever is more.

    A unit and a template match when 200 * |A and B| >= least * (|A| + |B|) over their sets of word bigrams; of several
    templates the one of the largest coefficient counts (ties: more bigrams, then the later name). Texts that lack the
    words which every match of some template needs are dropped by substring search before anything is split. The bound
    on |A| for a given |B| then drops templates, and units that fit none, before bigrams meet. The templates are the
    caller's list and so a literal of the plan; they meet the units in a hash join on the bigram.

    Null and empty texts, and units of fewer than two words, match nothing. Rows that repeat an id count as one document,
    whose units are those of all its rows; rows without an id are one document with a null id. An empty table, or no
    templates, gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    wanted = TEMPLATES + TEXTS if templates is None else templates
    listed = _listed(TEMPLATES if templates is None else templates)
    # all texts are read once; what may match anything is written, and both ways of matching read that
    parts = [x for _, grams in listed for x in necessary(grams, least)]
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    docs = written(docs.filter(may_hold(F.lower("text"), parts) | long_enough(F.col("text"), _listed(wanted), least)), "licence-texts")
    windows = window_matches(docs, wanted, least, "doc_id", "text")
    sizes = {len(grams) for _, grams in listed}
    low, high = min((n * least / (200 - least) for n in sizes), default=1), max((n * (200 - least) / least for n in sizes), default=0)
    entries = [F.struct(F.lit(k).alias("template"), F.lit(licence).alias("licence"), F.lit(len(grams)).alias("b"), F.lit(g).alias("gram")) for k, (licence, grams) in enumerate(listed) for g in grams]
    kind = "array<struct<template:int,licence:string,b:int,gram:string>>"
    index = spark.range(1).select(F.inline(F.array(*entries).cast(kind)))
    text = whole_text("text")
    kept = docs.filter(may_hold(F.lower("text"), parts))
    units = kept.select("doc_id", F.explode(F.when(F.contains(text, F.lit("\n")), F.concat(F.split(text, "\n"), F.array(text))).otherwise(F.array(text))).alias("unit"))
    sized = units.select("doc_id", normal_words(F.col("unit")).alias("words")).filter(F.size("words") > 1)
    counted = sized.select("doc_id", bigrams(F.col("words")).alias("grams")).withColumn("a", F.size("grams")).filter((F.col("a") >= low) & (F.col("a") <= high))
    keyed = counted.withColumn("unit_id", F.monotonically_increasing_id()).select("doc_id", "unit_id", "a", F.explode("grams").alias("gram"))
    met = keyed.join(F.broadcast(index), "gram").filter((F.col("a") * (200 - least) >= F.col("b") * least) & (F.col("b") * (200 - least) >= F.col("a") * least))
    overlap = met.groupBy("doc_id", "unit_id", "a", "template", "licence", "b").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") * 200 >= least * (F.col("a") + F.col("b")))
    total = (F.col("a") + F.col("b")).cast("long")
    best = overlap.groupBy("doc_id", "unit_id").agg(F.max(F.struct((2 * F.col("overlap") / total).alias("dice"), F.col("overlap"), F.col("licence"), total.alias("total"))).alias("best"))
    both = best.select("doc_id", "best", F.lit(False).alias("window")).unionByName(windows.select("doc_id", "best", F.lit(True).alias("window")))
    n = F.greatest(F.count_if(~F.col("window")), F.count_if(F.col("window")))
    return both.groupBy("doc_id", F.col("best.licence").alias("licence")).agg(n.alias("n_units"), F.max("best").alias("best")).select("doc_id", "licence", "n_units", F.col("best.overlap").alias("best_overlap"), F.col("best.total").alias("best_total"), F.col("best.dice").alias("dice"))


def _values() -> str:
    return ", ".join("({}, '{}', '{}')".format(k, x, t.replace("'", "''")) for k, (x, t) in enumerate(dict.fromkeys(TEMPLATES)))


SQL = rf"""
WITH t(template, licence, notice) AS (VALUES {_values()}),
u AS (SELECT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS unit FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, row_number() OVER () AS unit_id, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT DISTINCT doc_id, unit_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM n WHERE len(w) >= 2),
a AS (SELECT unit_id, count(*) AS a FROM g GROUP BY 1),
tw AS (SELECT template, licence, string_split(trim(regexp_replace(lower(notice), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM t),
tg AS (SELECT DISTINCT template, licence, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM tw),
b AS (SELECT template, count(*) AS b FROM tg GROUP BY 1),
m AS (SELECT doc_id, unit_id, template, licence, count(*) AS overlap FROM g JOIN tg USING (gram) GROUP BY ALL),
d AS (SELECT m.*, a + b AS total, 2 * overlap / (a + b) AS dice FROM m JOIN a USING (unit_id) JOIN b USING (template) WHERE 200 * overlap >= {LEAST} * (a + b)),
u1 AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY dice DESC, overlap DESC, licence DESC) AS k FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, overlap DESC) AS k2, count(*) OVER (PARTITION BY doc_id, licence) AS n_units FROM u1 WHERE k = 1)
SELECT doc_id, licence, n_units, overlap AS best_overlap, total AS best_total, dice FROM r WHERE k2 = 1
"""
