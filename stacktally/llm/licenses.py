"""Licence texts found by the Dice coefficient over word bigrams.

The words of a whole text, line ends or not, are compared to short templates by windows of
consecutive words, so a notice is found on a line of its own, inside a sentence, wrapped over
lines or within a whole licence. The coefficient reaches the threshold only if a window and a
template have similar numbers of bigrams, which bounds the windows, and only if most of the
template's bigrams are there, which rules out most texts for most templates. DataFrame functions
only; the one shuffle is of the matches.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacktally.llm.common import whole

DICE = 0.8

# Opening or notice texts of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
            "to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
                   "this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
                "terms of the GNU General Public License as published by the Free Software Foundation, "
                "either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be "
                     "used to endorse or promote products derived from this software without specific "
                     "prior written permission."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted, provided that the above copyright notice and this permission "
            "notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


class Template(NamedTuple):
    """A template's bigrams, the fewest of them that a match shares, and the longest window."""

    license: str
    bigrams: list[str]
    least: int
    longest: int


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def prepare(templates=TEMPLATES, dice: float = DICE) -> list[Template]:
    """``2 s / (w + n) >= dice`` with ``s <= w`` and ``s <= n`` bounds both s and w."""
    found = []
    for name, text in templates:
        grams = template_bigrams(text)
        n = len(grams)
        found.append(Template(
            name, grams, max(1, math.ceil(n * dice / (2 - dice) - 1e-9)), math.floor(n * (2 - dice) / dice + 1e-9)
        ))
    return found


def required(template: Template) -> list[str]:
    """Bigrams of which every match holds one: all but ``least - 1``, the longest ones."""
    by_length = sorted(template.bigrams, key=lambda g: (-len(g), g))
    return by_length[: len(by_length) - template.least + 1]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(whole(text)), r"[^\p{L}\p{N}]+", " "))


def _line_of_words(text: Column) -> Column:
    """The line, from 0, of each word of the normalised text."""
    lines = F.split(F.regexp_replace(F.lower(whole(text)), r"[^\p{L}\p{N}\n]+", " "), "\n")
    return F.flatten(F.transform(lines, lambda line, i: F.transform(
        F.filter(F.split(line, " "), lambda word: word != ""), lambda word: i
    )))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df.select`` whose results a later filter cannot make Spark compute again: they pass through a
    generator of one row, an outer one, as others are guarded by a filter on their input."""
    return df.select(F.explode_outer(F.array(F.struct(*columns))).alias("_row")).select("_row.*")


def scan(docs: DataFrame, dice: float = DICE, templates=TEMPLATES) -> DataFrame:
    """One row per line and licence of which a notice begins there: doc_id, line, license, dice.

    A window begins and ends with a bigram of the template (others at its ends only lower the
    coefficient) and has at most ``longest`` bigrams. Of the windows with one first word the best
    counts, the shorter of equals; it is a match from ``dice`` on, unless a better window of the
    template overlaps it, or as good a one that begins earlier. ``line`` is that of the first word,
    from 0, ``dice`` the best of the licence's matches beginning there, rounded to six digits.
    Null and empty texts give no rows, and documents that share an id, or have none, are reported
    together. A text's cost is linear in its length but for its matches: a template's windows are at
    most ``longest`` squared for each word of the text that begins enough shared bigrams.
    """
    prepared = [t for t in prepare(templates, dice) if t.bigrams]
    texts = _once(docs, F.col("doc_id"), F.col("text"), normalised(F.col("text")).alias("kept"))
    needed = sorted({gram for t in prepared for gram in required(t)})
    if not needed:
        return texts.limit(0).selectExpr("doc_id", "int(0) AS line", "'' AS license", "0D AS dice")
    texts = texts.filter(reduce(Column.__or__, [F.contains("kept", F.lit(gram)) for gram in needed]))

    words = texts.select("doc_id", "text", F.split("kept", " ").alias("words"))
    n_grams = F.size("words") - 1
    grams = words.select("doc_id", "text", F.zip_with(
        F.slice("words", F.lit(1), n_grams), F.slice("words", F.lit(2), n_grams), lambda a, b: F.concat_ws(" ", a, b)
    ).alias("grams"))
    every = sorted({gram for t in prepared for gram in t.bigrams})
    hits = _once(
        grams, F.col("doc_id"), F.col("text"), F.col("grams"),
        F.filter(
            F.transform("grams", lambda gram, i: F.struct(i.alias("at"), gram.alias("gram"))),
            lambda hit: hit["gram"].isin(every),
        ).alias("hits"),
    )

    def candidate(t: Template) -> Column:
        own = F.filter("hits", lambda hit: hit["gram"].isin(t.bigrams))
        return F.struct(
            F.lit(t.license).alias("license"), F.array(*map(F.lit, t.bigrams)).alias("bigrams"),
            F.lit(t.least).alias("least"), F.lit(t.longest).alias("longest"),
            F.transform(own, lambda hit: hit["at"]).alias("at"),
        )

    tried = hits.select("doc_id", "text", "grams", F.inline_outer(F.array(*map(candidate, prepared))))
    tried = tried.filter(F.size("at") >= F.col("least"))
    # Words from which on the fewest shared bigrams lie within the longest window.
    starts = _once(
        tried, *map(F.col, tried.columns),
        F.filter(
            F.sequence(F.lit(0), F.size("at") - F.col("least")),
            lambda i: F.get("at", i + F.col("least") - 1) - F.get("at", i) < F.col("longest"),
        ).alias("starts"),
    ).filter(F.size("starts") > 0)

    def best(i: Column) -> Column:
        first = F.get("at", i)
        ends = F.filter(
            F.slice("at", i + F.col("least"), F.col("longest")), lambda end: end - first < F.col("longest")
        )

        def window(end: Column) -> Column:
            found = F.array_distinct(F.slice("grams", first + 1, end - first + 1))
            shared = F.size(F.array_intersect(found, F.col("bigrams")))
            value = F.lit(2.0) * shared / (F.size(found) + F.size("bigrams"))
            return F.struct(value.alias("dice"), (-end).alias("minus_end"), first.alias("first"))

        return F.array_max(F.transform(ends, window))

    kept = ["doc_id", "text", "license", "longest"]
    windows = _once(
        starts, *map(F.col, kept),
        F.filter(F.transform("starts", best), lambda x: x["dice"] >= dice).alias("windows"),
    ).filter(F.size("windows") > 0)

    def beaten(x: Column, i: Column) -> Column:
        # Windows are in the order of their first words, so those that overlap are near.
        near = F.slice("windows", F.greatest(i + 2 - F.col("longest"), F.lit(1)), 2 * F.col("longest"))
        return F.exists(near, lambda y: (
            (y["first"] <= -x["minus_end"]) & (-y["minus_end"] >= x["first"])
            & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["first"] < x["first"])))
        ))

    matches = windows.select(
        "doc_id", "license", _line_of_words(F.col("text")).alias("line_of"),
        F.filter("windows", lambda x, i: ~beaten(x, i)).alias("matches"),
    )
    rows = matches.select("doc_id", "license", F.inline_outer(F.transform("matches", lambda x: F.struct(
        F.get("line_of", x["first"]).cast("int").alias("line"), F.round(x["dice"], 6).alias("dice")
    ))))
    return rows.groupBy("doc_id", "line", "license").agg(F.max("dice").alias("dice"))
