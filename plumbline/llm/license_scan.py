"""Licence scan with a trained paragraph classifier; the scan itself is DataFrame functions only.

A paragraph is a line of a document, or a window of words over a block of consecutive lines with words, so notices that
are wrapped or stand in comments are read as well. Its features are its distinct word n-grams (one to ``GRAM`` words). A multinomial
logistic regression with sparse weights over the n-grams of licence notices gives each family, and a class
"unknown", a probability; the temperature and the weight of "unknown" are calibrated on held-out variants. A predicted
family counts only if a template of that family confirms it: the n-grams of the paragraph must cover at least
``COVERAGE`` of those of one template.

The model is trained when first used, on the driver: from the fixed notices below, varied by leaving out, adding and
changing words, against sentences that use the same words otherwise. Its size is set by the notices, not by the input, so
the weights are a table of bounded size that goes to every task. Only documents, lines and windows with one of
``TRIGGERS`` (they count as unknown otherwise) or one of ``key_grams`` are split into n-grams. The key n-grams are
derived from the templates: of the k n-grams of a template any fixed ``k - ceil(COVERAGE * k) + 1`` will do, since a text
that has none of them cannot cover ``COVERAGE`` of it; the longest are taken, which other texts hardly hold.
Paragraphs and windows are known by numbers and word positions; no text takes part in a shuffle.

Edge cases: null and empty texts have no paragraph and no licence. A row is one document, also if doc_ids repeat or
are null. Equal paragraphs of a document count each. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
COVERAGE = 0.6
UNKNOWN = "unknown"
SEED = 6

# Notices of licence families.
TEMPLATES = {
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the GNU AGPL license v3 or later."),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "Artistic": ("This program is free software under the Artistic License 2.0.",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("Released under CC0 1.0, no rights reserved license.", "This work is dedicated to the public domain under the CC0 1.0 Universal license."),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL license v2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU LGPL license v3."),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "Proprietary": ("All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited; all rights reserved."),
    "Unlicense": ("This is free and unencumbered software released into the public domain under the Unlicense.",),
}
# Paragraphs of standard texts and headers.
FULL = {
    "AGPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",),
    "BSD": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",),
    "MIT": (
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}
# Sentences that use the words of notices without granting or reserving anything.
OTHER = (
    "A license is required to drive a car on public roads.", "The doctor lost the medical license last year.", "MIT is a university in Cambridge.",
    "Students at MIT released a report under the direction of two professors.", "The Apache helicopter was released in version 64.", "Licensed plumber under contract.",
    "Please read the license before you install the software.", "Copyright law is a difficult subject.", "The library is open to the general public.",
    "The general public may use the software of the library.", "Version 2.0 of the app was released.", "This work is difficult under the conditions of the north.",
    "All seats are reserved.", "All rights of way are closed for the winter.", "The fishing license can be obtained at the town hall.", "What does the license say about commercial use?",
    "License plates are made of metal.", "We compare license families such as permissive and copyleft.", "The permission was granted to any person free of charge.",
    "Creative people work in common rooms.", "The copyright notice was missing.", "The band licensed the song to a film studio.", "Redistribution of wealth is a matter of debate.",
    "He reserved all tickets under a false name.", "The driver license office is closed.", "A licensed guide leads the tour, version three of it.", "The public domain is a legal idea.",
    "Wines are sold under license.", "A software license can cost more than the hardware.", "The gnu is an animal of the plains.",
)
WINDOWS = ((24, 8), (72, 24))  # words and step of the windows over a block of lines
GAP = r"\n(?:[^a-z0-9\n]*\n)+"  # lines without a word, comment marks included, end a block
TRIGGERS = r"licen[sc]|rights reserved|redistribution and use|permission is hereby|spdx"
WORD = r"[a-z0-9]+"
BETWEEN = r"[^a-z0-9]++(?:(?:rem|dnl)[ \t][^a-z0-9]*+)?"  # two words of a text that may be wrapped and commented
_NOISE = "of and the in that file see for more project page section here data our your text code this site it on as with by".split()


def grams(text: str) -> set[str]:
    words = re.findall(WORD, text.lower())
    return {" ".join(words[i:i + n]) for n in range(1, GRAM + 1) for i in range(len(words) - n + 1)}


def _texts() -> list[tuple[str, str]]:
    return [(family, t) for family, ts in TEMPLATES.items() for t in (*ts, *FULL.get(family, ()))]


def _variant(text: str, rng: np.random.Generator) -> str:
    words = [w for w in text.split() if rng.random() > 0.1] or text.split()
    noise = list(rng.choice(_NOISE, 2 * int(rng.integers(0, 5))))
    at = len(noise) // 2
    return " ".join([*noise[:at], *words, *noise[at:]])


def _examples(rng: np.random.Generator, copies: int) -> tuple[list[set[str]], np.ndarray]:
    families = [*TEMPLATES, UNKNOWN]
    texts, labels = [], []
    for k, family in enumerate(families):
        for text in [t for f, t in _texts() if f == family] or OTHER:
            texts += [text, *(_variant(text, rng) for _ in range(copies))]
            labels += [k] * (copies + 1)
    for _, text in _texts():  # a few words of a notice are no notice
        words = text.split()
        for _ in range(2):
            start = int(rng.integers(0, len(words)))
            part = words[start:start + max(1, len(words) // 4)]
            texts.append(" ".join([*rng.choice(_NOISE, 6), *part, *rng.choice(_NOISE, 6)]))
            labels.append(len(families) - 1)
    return [grams(t) for t in texts], np.array(labels)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.cache
def model() -> dict:
    """Vocabulary, weights, bias, temperature and the templates' n-grams; trained once per driver."""
    families = [*TEMPLATES, UNKNOWN]
    vocabulary = sorted(set().union(*(grams(t) for _, t in _texts())))
    index = {g: i for i, g in enumerate(vocabulary)}

    def matrix(sets):
        x = np.zeros((len(sets), len(vocabulary)))
        for r, s in enumerate(sets):
            x[r, [index[g] for g in s if g in index]] = 1
        return x

    rng = np.random.default_rng(SEED)
    sets, y = _examples(rng, 6)
    x, target = matrix(sets), np.eye(len(families))[y]
    weights, bias = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(200):
        error = (_softmax(x @ weights + bias) - target) / len(y)
        speed_w = 0.9 * speed_w - 1.0 * (x.T @ error + 1e-5 * weights)
        speed_b = 0.9 * speed_b - 1.0 * error.sum(0)
        weights, bias = weights + speed_w, bias + speed_b
    weights[np.abs(weights) < 1e-3] = 0
    held, truth = _examples(rng, 3)
    logits = matrix(held) @ weights + bias
    best = (np.inf, 1.0, 0.0)
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        for shift in (-2.0, -1.0, 0.0, 1.0, 2.0):
            moved = logits / temperature
            moved[:, -1] += shift
            loss = -np.log(_softmax(moved)[np.arange(len(truth)), truth] + 1e-12).mean()
            best = min(best, (loss, temperature, shift))
    _, temperature, shift = best
    bias = bias / temperature
    bias[-1] += shift
    templates = [(family, grams(t)) for family, t in _texts()]
    return {"families": families, "vocabulary": vocabulary, "weights": weights / temperature, "bias": bias, "templates": templates}


@functools.cache
def key_grams() -> list[str]:
    """n-grams of which every text has one that covers ``COVERAGE`` of a template; long ones, fixed with the model."""
    shared_by = Counter(g for _, t in model()["templates"] for g in t)
    chosen: set[str] = set()
    for _, template in model()["templates"]:
        needed = len(template) - math.ceil(COVERAGE * len(template) - 1e-9) + 1
        chosen |= set(sorted(template, key=lambda g: (-g.count(" "), -min(map(len, g.split())), -len(g), -shared_by[g], g))[:needed])
    inside = lambda g: {" ".join(w[i:j]) for w in [g.split()] for i in range(len(w)) for j in range(i + 1, len(w) + 1)} - {g}
    return sorted(g for g in chosen if chosen.isdisjoint(inside(g)))  # what holds a longer one holds the shorter one


@functools.cache
def key_pattern() -> str:
    """Pattern of lower-case texts with one of the key n-grams, comment marks between its words allowed."""
    tree: dict = {}
    for g in key_grams():
        node = tree
        for c in g + "\n":
            node = node.setdefault(c, {})

    def pattern(node: dict) -> str:
        parts = []
        for c, below in sorted(node.items()):
            parts.append("(?![a-z0-9])" if c == "\n" else (BETWEEN if c == " " else c) + pattern(below))
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return "(?<![a-z0-9])" + pattern(tree)


def _runs(n: int):
    """All runs of ``n`` words of the column ``words``."""
    starts = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))


def _windows(words, size: int, step: int):
    """First words of overlapping windows of ``size`` words, one at least, and the windows."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + step), F.lit(step))
    return F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.slice(words, i, size).alias("words")))


def _units(text):
    """Lines with a trigger or key n-gram, and windows with a key n-gram, of a lower-case text."""
    key = key_pattern()
    found = lambda words: F.array_join(words, " ").rlike(key)
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        i.alias("paragraph"), F.lit(0).alias("start"), F.regexp_extract_all(line, F.lit(f"({WORD})")).alias("words"), F.lit(False).alias("window"), line.rlike(TRIGGERS).alias("trigger")))
    blocks = F.split(F.regexp_replace(text, r"(?m)^[^a-z0-9\n]*(?:rem|dnl)[ \t]", ""), GAP)
    words = F.transform(blocks, lambda b: F.regexp_extract_all(F.when(b.rlike(key), b).otherwise(""), F.lit(f"({WORD})")))
    windows = F.flatten(F.transform(words, lambda w, i: F.transform(F.concat(*[_windows(w, *sizes) for sizes in WINDOWS]), lambda c: F.struct(
        i.alias("paragraph"), c["start"].alias("start"), c["words"].alias("words"), F.lit(True).alias("window"), F.lit(False).alias("trigger")))))
    return F.concat(F.filter(lines, lambda p: p["trigger"] | found(p["words"])), F.filter(windows, lambda p: found(p["words"])))


def paragraph_licences(docs: DataFrame) -> DataFrame:
    """Per line or window that has a trigger or key n-gram: row_id, doc_id, unit, paragraph (number of the line or block of lines), start and size (in words),
    window, trigger, family, probability, coverage, confirmed; documents without one have one row without unit."""
    m = model()
    families, templates = m["families"], m["templates"]
    columns = [f"w{k}" for k in range(len(families))] + [f"t{k}" for k in range(len(templates))]
    rows = [
        (g, *(float(w) for w in m["weights"][i]), *(1.0 / len(t) if g in t else 0.0 for _, t in templates)) for i, g in enumerate(m["vocabulary"])]
    rows.append(("", *[0.0] * len(columns)))  # every unit has this one, so that it stays when it has no other
    # bounded by the notices above
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, "gram string, " + ", ".join(f"{c} double" for c in columns)))
    # numbered in a step of its own: inside the one that explodes, every line would get a number
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    units = F.when(F.col("text").rlike(f"{TRIGGERS}|{key_pattern()}"), _units(F.col("text")))
    place = ["row_id", "doc_id", "unit", "paragraph", "start", "size", "window", "trigger"]
    lines = numbered.select("row_id", "doc_id", F.posexplode_outer(units).alias("unit", "p")).select(
        "row_id", "doc_id", "unit", "p.paragraph", "p.start", F.size("p.words").alias("size"), "p.window", "p.trigger", "p.words")
    sizes = [_runs(n) for n in range(1, GRAM + 1)]
    nothing = F.array(F.lit(""))
    split = lines.withColumn("gram", F.explode(F.coalesce(F.concat(nothing, F.array_distinct(F.concat(*sizes))), nothing))).drop("words")
    sums = split.join(table, "gram").groupBy(*place).agg(*[F.sum(c).alias(c) for c in columns])
    logits = [F.col(f"w{k}") + F.lit(float(b)) for k, b in enumerate(m["bias"])]
    top = F.greatest(*logits)
    total = sum((F.exp(z - top) for z in logits[1:]), F.exp(logits[0] - top))
    family = F.coalesce(*[F.when(z == top, F.lit(f)) for z, f in zip(logits, families)])
    cover = F.coalesce(*[
        F.when(F.col("family") == f, F.greatest(*[F.col(f"t{k}") for k, (g, _) in enumerate(templates) if g == f], F.lit(0.0))) for f in TEMPLATES], F.lit(0.0))
    best = F.greatest(*[f"t{k}" for k in range(len(templates))])  # part of a notice in a window is no notice of a family that is worded alike
    named = sums.select(*place, family.alias("family"), (1 / total).alias("probability"), *columns[len(families):])
    return named.withColumn("coverage", cover).select(
        *place, "family", "probability", "coverage", ((F.col("coverage") >= COVERAGE - 1e-9) & (~F.col("window") | (F.col("coverage") >= best - 1e-9))).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (confirmed families, sorted, joined by a comma), n_notices and n_unknown per row of ``docs``.

    Notices are confirmed lines and the families that only windows confirm; unknown are the other lines with a trigger.
    """
    named = lambda flag: F.collect_set(F.when(F.col("confirmed") & flag, F.col("family")))
    number = lambda flag: F.coalesce(F.sum((F.col("unit").isNotNull() & ~F.col("window") & flag).cast("long")), F.lit(0))
    wrapped = F.size(F.array_except(named(F.col("window")), named(~F.col("window"))))
    return paragraph_licences(docs).groupBy("row_id", "doc_id").agg(
        F.array_join(F.sort_array(named(F.lit(True))), ",").alias("licences"), (number(F.col("confirmed")) + wrapped).alias("n_notices"),
        number(~F.col("confirmed") & F.col("trigger")).alias("n_unknown")).drop("row_id")
