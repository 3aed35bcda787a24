"""License scans (operator 1), in DataFrame functions alone.

Texts and templates are sequences of lower-case words and their 5-word shingles. A window of a text, as long as
a template and overlapping the next by seven eighths, retrieves the template if both have the same least hash in one
of the bands; the shingles of the two are then compared one by one.

A window agrees with a template in a band only if it holds the shingle of the template's least hash. So the shingles
of a text are joined with that one shingle of each template and band, and only windows around such a place are hashed:
the same windows are retrieved, at the cost of one lookup for each word, however many templates there are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import documents

SHINGLE, CONTAINMENT = 5, 0.8
#: Windows to a template's length; a verbatim template is off a window's start by half a step at most.
STEPS = 8
#: Probability with which a template that a text contains to CONTAINMENT shares a band with its window.
RECALL = 0.999

#: Templates whose bands go to every task at a time, about (some 30 bytes for each of the bands); more are searched for in turns.
MAX_TEMPLATES = 20_000
#: Words of a text that are looked up together, at least; with what windows reach beyond them, all that a row holds of a text.
PIECE = 1024

#: Fixed values: (template, license, wording) of common notices.
TEMPLATES = (
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-header", "LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("apache-2-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2-header", "Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("bsd-conditions", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(found: Column) -> Column:
    """A hash of each shingle, by its first word. A sequence of fewer words has none."""
    hashed = F.transform(found, lambda w, i: F.xxhash64(w, *(F.get(found, i + k) for k in range(1, SHINGLE))))
    return F.slice(hashed, 1, F.greatest(F.size(found) - (SHINGLE - 1), F.lit(0)))


def _shingles(found: Column) -> Column:
    """The distinct shingles of a sequence of words, as text."""
    starts = F.when(F.size(found) >= SHINGLE, F.sequence(F.lit(1), F.size(found) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(found, i, SHINGLE))))


def bands(containment: float = CONTAINMENT, steps: int = STEPS, recall: float = RECALL) -> int:
    """Bands of one row that find a contained template with probability `recall`.

    The nearest of the windows of the template's own length is off by 1 / (2 steps) of it at most, so of s shingles of the
    template at least s (containment - 1 / (2 steps)) are in the window of s shingles: a similarity of at least
    j = x / (2 - x) with x that share. A band of one row agrees with probability j, and b of them do not with (1 - j)^b.
    """
    shared = containment - 1 / (2 * steps)
    return math.ceil(math.log(1 - recall) / math.log(1 - shared / (2 - shared)))


def template_table(spark: SparkSession, templates: tuple | DataFrame = TEMPLATES) -> DataFrame:
    """(template_id, license, words, shingles, hashes) of (template_id, license, wording)."""
    if not isinstance(templates, DataFrame):
        names = ("template_id", "license", "wording")
        templates = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, t, strict=True))) for t in templates))))
    told = templates.select("template_id", "license", _words(F.col("wording")).alias("found"))
    return told.select("template_id", "license", F.size("found").alias("words"), _shingles(F.col("found")).alias("shingles"), _hashes(F.col("found")).alias("hashes"))


def band_table(templates: DataFrame, n: int) -> DataFrame:
    """(template_id, words, band, least, hash): the least of a band's hashes, and the shingle it is of, n for each template."""
    band = lambda k: F.struct(F.lit(k).alias("band"), F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.lit(k)).alias("least"), h.alias("hash")))).alias("best"))
    signed = templates.select("template_id", "words", F.explode(F.array(*map(band, range(n)))).alias("s"))
    return signed.select("template_id", "words", "s.band", "s.best.least", "s.best.hash")


def pieces(docs: DataFrame, reach: int) -> DataFrame:
    """(doc_id, row, base, lead, found, hashes): texts in pieces of PIECE words or more, with `reach` words on either side.

    found and hashes begin at word `lead` of the text, the piece itself at word `base`.
    """
    step = max(PIECE, reach)
    whole = docs.select("doc_id", _words(F.col("text").cast("string")).alias("all")).where(F.size("all") >= SHINGLE)
    # The row number keeps conditions above the words: pushed below them, they would take the words anew for each shingle.
    whole = whole.select("doc_id", "all", F.monotonically_increasing_id().alias("row"))
    lead = lambda b: F.greatest(F.lit(0), b - reach)
    piece = lambda b: F.struct(b.alias("base"), lead(b).alias("lead"), F.slice("all", lead(b) + 1, b - lead(b) + step + reach + SHINGLE).alias("found"))
    # Pieces are made before they are dealt out, so that no row of a piece holds the text.
    cut_up = whole.select("doc_id", "row", F.explode(F.transform(F.sequence(F.lit(0), F.size("all") - SHINGLE, F.lit(step)), piece)).alias("piece"))
    return cut_up.select("doc_id", "row", "piece.*").withColumn("hashes", _hashes(F.col("found")))


def _scan(docs: DataFrame, table: DataFrame, reach: int, n: int, containment: float) -> DataFrame:
    own = F.slice("hashes", F.col("base") - F.col("lead") + 1, F.lit(max(PIECE, reach)))
    # A piece meets each shingle once, however often it holds it, and its places are found in the piece.
    hits = pieces(docs, reach).select("*", F.explode(F.array_distinct(own)).alias("hash")).join(F.broadcast(band_table(table, n)), "hash")
    hits = hits.withColumn("own", own).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("words") / STEPS).cast("int")))
    places = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: F.get(F.col("own"), i) == F.col("hash"))
    low = lambda p: F.greatest(F.lit(0), F.ceil((p - F.col("words") + SHINGLE) / F.col("step")).cast("int"))
    around = lambda i: F.sequence(low(F.col("base") + i), F.floor((F.col("base") + i) / F.col("step")).cast("int"))
    windows = hits.withColumn("windows", F.array_distinct(F.flatten(F.transform(places, around))))
    shingled = lambda k: F.slice("hashes", k * F.col("step") - F.col("lead") + 1, F.col("words") - (SHINGLE - 1))
    agree = lambda k: F.array_min(F.transform(shingled(k), lambda h: F.xxhash64(h, F.col("band")))) == F.col("least")
    margin = F.floor(F.col("words") / 4).cast("int")

    def wide(k: Column) -> Column:
        start = k * F.col("step")
        first = F.greatest(F.lit(0), start - margin)
        return F.struct(start.alias("start"), F.slice("found", first - F.col("lead") + 1, start - first + F.col("words") + margin).alias("around"))

    met = windows.select("doc_id", "row", "template_id", F.explode(F.transform(F.filter("windows", agree), wide)).alias("w"))
    met = met.select("doc_id", "row", "template_id", "w.*").dropDuplicates(["row", "template_id", "start"])
    share = F.size(F.array_intersect("shingles", _shingles(F.col("around")))) / F.size("shingles")
    held = met.join(table, "template_id").select("doc_id", "template_id", "license", "start", share.alias("containment")).where(F.col("containment") >= containment)
    return held.groupBy("doc_id", "template_id", "license").agg(F.max(F.struct(F.col("containment"), (-F.col("start")).alias("back"))).alias("best"))


def scan(docs: DataFrame, templates: tuple | DataFrame = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, template_id, license, first_word, containment): the templates whose shingles a window of the text holds to `containment`.

    `templates` are rows (template_id, license, wording), of SHINGLE words at least. More than about MAX_TEMPLATES are
    searched for in turns, each a scan of the texts.

    The best window of each document and template counts, of equals the first; it reaches a quarter of the
    template's length beyond the window on either side. Null and short texts match nothing; rows that repeat a
    doc_id count as one document; texts are read whole, a piece at a time; extra columns are ignored; empty tables give
    no rows.
    """
    spark, n = docs.sparkSession, bands(containment)
    table = template_table(spark, templates)
    told = table.agg(F.count("*").alias("n"), F.count_if(F.col("words") < SHINGLE).alias("short"), F.max("words").alias("longest")).first()
    if told["short"]:
        raise ValueError(f"{told['short']} templates of fewer than {SHINGLE} words")
    turns, reach = math.ceil(told["n"] / MAX_TEMPLATES) or 1, math.ceil(1.25 * (told["longest"] or 0)) + 1
    parts = [_scan(docs, table.where(F.pmod(F.xxhash64("template_id"), F.lit(turns)) == k) if turns > 1 else table, reach, n, containment) for k in range(turns)]
    best = reduce(DataFrame.unionByName, parts)
    return best.select("doc_id", "template_id", "license", (-F.col("best.back")).cast("long").alias("first_word"), F.col("best.containment").alias("containment"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the license templates it contains."""
    return scan(documents(spark, sf_dir))
