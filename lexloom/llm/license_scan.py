"""Licence scan (native: DataFrame functions only).

A document's lines, its paragraphs (parted by blank lines) of several lines and its whole text are normalised (lower case,
runs of letters and digits parted by one space) and compared with licence templates by the Dice coefficient over their
sets of word bigrams: 2 * common / (size of one + size of the other). So are, for notices wrapped over lines or inside longer
ones, all windows of consecutive words of the whole text: of a template of h bigrams, those of up to h * (2 - t) / t bigrams.

Size bounds prune: a Dice of t or more needs a set size between t / (2 - t) and (2 - t) / t times the template's, so a
passage meets only the templates filed under its own set size, an equi-join with a table whose rows are bounded by the
templates given. A window of a Dice of t or more has t / (2 - t) of a template's h bigrams, so one at least of any few more
than the rest: only documents with one of these (anchors; the longest are taken) are looked at. The best window begins and ends
with a bigram of the template, and so many of them must follow its begin closely; only such windows are compared.

Defined results: null and empty texts, and passages of under two words, match nothing. Of a document's passages the best
for each licence is returned; ties go to what isn't a window, then to the earlier place (of a window: the number of words before
it), then to the kind later in the alphabet. Rows with the same document key are taken as
passages of one document. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm._work import written

#: Short public licence notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Bigrams of the template table that may be broadcast.
BROADCAST_BIGRAMS = 500_000
#: Anchors looked up in a document before the join; more are left to the join. Anchors sought in every text before all else.
LOOKED_UP, SOUGHT = 2000, 400


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def pairs(normalised: Column) -> Column:
    """The word bigrams of a normalised text, in order; empty for under two words."""
    w = F.split(normalised, " ")
    return F.slice(F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b)), 1, F.greatest(F.size(w) - 1, F.lit(0)))


def bigrams(normalised: Column) -> Column:
    """The set of word bigrams of a normalised text; empty for under two words."""
    return F.array_distinct(pairs(normalised))


def _sized_templates(templates: Mapping[str, list[str]], least: float) -> list[tuple[str, list[str], int, int]]:
    """license, have, and the least and most bigrams of a set that may match."""
    rows = []
    for name, texts in templates.items():
        for text in texts:
            w = re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")
            have = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
            lo, hi = math.ceil(len(have) * least / (2 - least) - 1e-9), math.floor(len(have) * (2 - least) / least + 1e-9)
            rows += [(name, have, max(1, lo), hi)] if have else []
    return rows


def passages(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, kind, at, passage: every line, every paragraph of two lines or more, and the whole text if it has two lines or more."""
    t = F.col(text)
    lines = F.transform(F.split(t, "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("at"), x.alias("passage")))
    paras = F.filter(F.transform(F.split(t, r"\n[\x20\x09-\x0D]*\n"), lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("at"), x.alias("passage"))), lambda z: z["passage"].contains("\n"))
    whole = F.when(t.contains("\n\n"), F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("at"), t.alias("passage")))).otherwise(F.array().cast("array<struct<kind:string,at:int,passage:string>>"))
    return df.where(t.isNotNull()).select(F.col(key).alias("doc"), F.inline(F.concat(lines, paras, whole)))


def _anchors(have: list[str], lo: int) -> list[str]:
    """Bigrams of a template of which each match has one."""
    return sorted(have, key=lambda x: (-len(x), x))[: len(have) - lo + 1]


def _holding_any(df: DataFrame, text: str, wanted: list[str]) -> DataFrame:
    """The rows whose normalised text has one of these pieces (sorted) in it, from the begin of a word on: no other can have a passage or a window that matches, as these are parts of the text and their words are its own."""
    by_first = [f"{c}(?:{'|'.join(a[1:] for a in own)})" for c, own in groupby(wanted, key=lambda a: a[0])]
    return df.where(F.concat(F.lit(" "), normal(F.col(text))).rlike(f" (?:{'|'.join(by_first)})") if wanted else F.lit(False))


def _windows(df: DataFrame, key: str, text: str, known: list[tuple[str, list[str], int, int]], least: float) -> DataFrame:
    """doc, license, dice, kind (window), at: the best window from each of its begins with a Dice of least or more."""
    rows = []
    for name, have, lo, hi in known:
        anchors = _anchors(have, lo)
        rows += [(x, anchors, name, have, lo, hi) for x in anchors]
    table = df.sparkSession.createDataFrame(rows, "anchor string, anchors array<string>, license string, have array<string>, lo int, hi int")
    table = F.broadcast(table) if sum(len(r[1]) + len(r[3]) for r in rows) <= BROADCAST_BIGRAMS else table
    wanted = sorted({r[0] for r in rows})
    words = df.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), pairs(normal(F.col(text))).alias("b"))
    seen = F.array_intersect("b", F.array(*map(F.lit, wanted)).cast("array<string>")) if len(wanted) <= LOOKED_UP else F.array_distinct("b")
    seen = words.withColumn("seen", seen).where(F.size("seen") > 0).select("*", F.explode("seen").alias("anchor"))
    # Once for each template, by the first of its anchors.
    met = seen.join(table, "anchor").where(F.col("anchor") == F.get(F.array_intersect("anchors", "seen"), F.lit(0)))
    met = met.where(F.size(F.array_intersect("b", "have")) >= F.col("lo")).select("doc", "b", "license", "have", "lo", "hi")
    hits = met.withColumn("hits", F.filter(F.transform("b", lambda x, i: F.when(F.array_contains("have", x), i)), lambda i: i.isNotNull()))
    begins = F.filter(F.transform("hits", lambda p, k: F.when(F.get("hits", k + F.col("lo") - 1) - p < F.col("hi"), p)), lambda p: p.isNotNull())
    begun = hits.select("doc", "license", "have", "lo", "b", "hi", F.explode(begins).alias("at")).withColumn("b", F.slice("b", F.col("at") + 1, F.col("hi")))
    ends = F.filter(F.sequence("lo", F.size("b")), lambda n: F.array_contains("have", F.get("b", n - 1)))

    def dice(n: Column) -> Column:
        own = F.slice("b", F.lit(1), n)
        return 2.0 * F.size(F.array_intersect(own, F.col("have"))) / (F.size(F.array_distinct(own)) + F.size("have"))

    out = begun.select("doc", "license", F.array_max(F.transform(ends, dice)).alias("dice"), F.lit("window").alias("kind"), "at")
    return out.where(F.col("dice") >= least)


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """key, license, dice, kind, at: for each document and licence the best passage with a Dice of least or more."""
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and not above 1")
    spark = df.sparkSession
    known = _sized_templates(TEMPLATES if templates is None else templates, least)
    rows = [(n, name, have) for name, have, lo, hi in known for n in range(lo, hi + 1)]
    table = spark.createDataFrame(rows, "n int, license string, have array<string>")
    # A row for each template and size it may meet: so few that they go to every task; more are shuffled.
    table = F.broadcast(table) if sum(map(len, (r[2] for r in rows))) <= BROADCAST_BIGRAMS else table
    most = max((r[0] for r in rows), default=0)
    wanted = sorted({x for _, own, lo, _ in known for x in _anchors(own, lo)})
    if len(wanted) <= SOUGHT:
        # Written, as passages and windows would each look through all texts.
        df = written(_holding_any(df.select(key, text), text, wanted), "sought")
    found = passages(df, key, text)
    sized = found.withColumn("b", bigrams(normal(F.col("passage")))).drop("passage").withColumn("n", F.size("b")).where(F.col("n").between(1, most))
    common = F.size(F.array_intersect("b", "have"))
    scored = sized.join(table, "n").withColumn("dice", 2.0 * common / (F.col("n") + F.size("have"))).where(F.col("dice") >= least)
    scored = scored.select("doc", "license", "dice", "kind", "at").unionByName(_windows(df, key, text, known, least))
    best = F.max_by(F.struct("dice", "kind", "at"), F.struct("dice", F.col("kind") != "window", -F.col("at"), F.col("kind")))
    out = scored.groupBy("doc", "license").agg(best.alias("x"))
    return out.select(F.col("doc").alias(key), "license", "x.dice", "x.kind", "x.at")
