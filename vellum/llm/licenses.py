"""Licence notices in paragraphs, by a trained classifier and templates.

A paragraph is a line of a text that holds a word. A softmax regression over
word 1- to 3-grams gives a family, ``none`` (no licence notice) or ``unknown``
(a notice of some other licence). It learns from the notices below, varied by
seeded edits, and from about ``NEGATIVES`` corpus paragraphs (drawn by hash,
twice as many at most; their first 400 characters) as ``none``; a quarter of the varied notices is held out to fit the
temperature that calibrates the probabilities and the probability below which
a family becomes ``unknown``. A predicted family is then compared with that
family's notices: without enough common word pairs it is ``unknown`` too.

Features are n-grams of the notices that hold a word other than
``FUNCTION_WORDS``. A paragraph without such a word has no feature and is
``none`` whatever else it says, so texts without any are passed over.

Defined cases: null, empty and blank texts have no paragraphs; repeated rows
and ids are scanned one by one; an empty table trains on the notices alone
and gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEGATIVES = 3000
VARIANTS = 40
HELD_OUT = 4
CONFIRM = 0.5
PRECISION = 0.99

# Notices by family (fixed values: the customary wording of each licence).
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at",
                   "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation; either version 2 of the License",
            "SPDX-License-Identifier: GPL-2.0-only"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction",
            "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. Unauthorized copying or distribution of this document is strictly prohibited.",
                    "This material is confidential and proprietary and may not be reproduced without written permission."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    # notices of other licences
    "unknown": ["Licensed under the Example Software License, Version 1.1.", "Released under the terms of our own license.",
                "This file is distributed under the Sample Community License agreement.",
                "The use of this material is subject to a license agreement.", "SPDX-License-Identifier: LicenseRef-Custom"],
}

FUNCTION_WORDS = frozenset(
    "a all an and any are as at be by can for form from has have in into is it may not of on or other our own possible "
    "related terms that the this to under use with without work you".split())

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(w: list[str], most: int = 3) -> set[str]:
    return {" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)}


def pairs(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w[:-1], w[1:], strict=True)) if len(w) > 1 else {(w[0], "")} if w else set()


@dataclass
class Model:
    """Bounded by the notices, whatever the corpus."""

    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # (features + 1, families); the last row is the intercept
    temperature: float
    least: float  # probability below which a family becomes unknown

    def __post_init__(self):
        self.content = frozenset(g for g in self.vocabulary if " " not in g)
        self.notices = {f: [pairs(words(t)) for t in TEMPLATES.get(f, [])] for f in self.families}

    def probabilities(self, w: list[str]) -> np.ndarray:
        at = [self.vocabulary[g] for g in grams(w) if g in self.vocabulary]
        z = (self.weights[at].sum(axis=0) + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, w: list[str], family: str) -> float:
        """Common word pairs with the family's nearest notice, of the shorter one."""
        own = pairs(w)
        return max((len(own & n) / max(1, min(len(own), len(n))) for n in self.notices[family]), default=0.0)

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(family, probability, similarity to the family's notices)."""
        w = words(paragraph)
        if self.content.isdisjoint(w):
            return "none", 1.0, 0.0
        p = self.probabilities(w)
        best = int(p.argmax())
        family = self.families[best]
        if family in ("none", "unknown"):
            return family, float(p[best]), 0.0
        near = self.similarity(w, family)
        if p[best] < self.least or near < CONFIRM:
            return "unknown", float(p[best]), near
        return family, float(p[best]), near


def _vary(w: list[str], rng: np.random.Generator, filler: list[str]) -> list[str]:
    """A notice as it is met: words lost, text around it, cut short."""
    kind = rng.random()
    out = [x for x in w if rng.random() > (0.08 if kind < 0.6 else 0.0)] or w
    if kind > 0.5 and filler:
        n = int(rng.integers(1, 7))
        side = [filler[int(i)] for i in rng.integers(0, len(filler), n)]
        out = side + out if rng.random() < 0.5 else out + side
    if kind > 0.85 and len(out) > 12:
        out = out[:int(len(out) * 0.7)]
    return out


def _softmax_fit(x: list[list[int]], y: np.ndarray, width: int, classes: int, l2: float = 1e-4,
                 steps: int = 300) -> np.ndarray:
    """Softmax regression on sparse binary rows, classes weighted evenly."""
    row = np.repeat(np.arange(len(x)), [len(r) + 1 for r in x])
    column = np.concatenate([np.array([*r, width]) for r in x])
    share = (1 / (np.bincount(y, minlength=classes)[y] * classes))[:, None]
    truth = np.eye(classes)[y]
    w = np.zeros((width + 1, classes))
    v, t = w.copy(), 1.0
    rate = 4.0 / (np.bincount(row) * share[:, 0]).sum()
    for _ in range(steps):
        z = np.zeros((len(x), classes))
        np.add.at(z, row, v[column])
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = share * (p - truth)
        grad = np.zeros_like(w)
        np.add.at(grad, column, g[row])
        new = v - rate * (grad + l2 * v)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w


def fit(negatives: list[str], seed: int = 5) -> Model:
    """Model from the notices and corpus paragraphs that are none."""
    rng = np.random.default_rng(seed)
    families = ["none", *sorted(TEMPLATES)]
    notices = {f: [words(t) for t in TEMPLATES[f]] for f in TEMPLATES}
    vocabulary = {g: i for i, g in enumerate(sorted(
        {g for f in notices for w in notices[f] for g in grams(w) if any(x not in FUNCTION_WORDS for x in g.split())}))}
    every = [pairs(w) for f in notices for w in notices[f]]
    plain = [w for w in map(words, negatives)  # corpus paragraphs that look like a notice are left out
             if w and all(len(pairs(w) & n) < CONFIRM * min(len(pairs(w)), len(n)) for n in every)]
    filler = [x for w in plain for x in w][:20_000]
    rows, y, held = [], [], []
    for f in sorted(notices):
        for w in notices[f]:
            for n in range(VARIANTS):
                rows.append(w if n == 0 else _vary(w, rng, filler))
                y.append(families.index(f))
                held.append(n % HELD_OUT == 1)
    for i, w in enumerate([[], *plain]):
        rows.append(w)
        y.append(0)
        held.append(i % HELD_OUT == 1)
    x = [[vocabulary[g] for g in sorted(grams(w)) if g in vocabulary] for w in rows]
    y, held = np.array(y), np.array(held)
    learn = np.flatnonzero(~held)
    weights = _softmax_fit([x[i] for i in learn], y[learn], len(vocabulary), len(families))
    z = np.stack([weights[x[i]].sum(axis=0) + weights[-1] for i in np.flatnonzero(held)])
    truth = y[held]

    def soft(t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(soft(t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = soft(temperature)
    best, guess = p.max(axis=1), p.argmax(axis=1)
    named = ~np.isin(guess, [0, families.index("unknown")])
    least = 0.5
    for cut in np.sort(best[named]):  # the lowest cut at which what is left is right often enough
        left = named & (best >= cut)
        if (guess[left] == truth[left]).mean() >= PRECISION:
            least = max(0.5, float(cut))
            break
    return Model(families, vocabulary, weights, temperature, least)


def train(docs: DataFrame, text_col: str = "text", negatives: int = NEGATIVES) -> Model:
    """Model with ``none`` learnt from about ``negatives`` different
    paragraphs, drawn by their own hash: copies of a line are drawn once, and
    the draw does not depend on how rows are dealt."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).filter(F.trim("line") != "")
    lines = lines.select(F.xxhash64("line").alias("h"), F.substring("line", 1, 400).alias("line"))
    different = lines.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    every = max(1, -(-different // negatives))  # about one line in `every`: no task sends more than its share
    sample = lines.filter(F.pmod("h", F.lit(every)) == 0).groupBy("h").agg(F.min("line").alias("line"))
    return fit(sorted(r["line"] for r in sample.orderBy("h").limit(2 * negatives).collect()))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_paragraphs`` and ``notices``, an array
    of (paragraph, start, family, probability, similarity) for every
    paragraph that is not ``none``; paragraphs and characters count from 0."""
    model = model or train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    notice = pa.struct([("paragraph", pa.int32()), ("start", pa.int64()), ("family", pa.string()),
                        ("probability", pa.float64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            counts, found = [], []
            for text in b.column(1).to_pylist():
                lines = (text or "").split("\n")
                counts.append(sum(1 for x in lines if x.strip()))
                out = []
                if text and not m.content.isdisjoint(words(text)):
                    at = n = 0
                    for line in lines:
                        if line.strip():
                            family, p, near = m.classify(line)
                            if family != "none":
                                out.append((n, at, family, p, near))
                            n += 1
                        at += len(line) + 1
                found.append([dict(zip(("paragraph", "start", "family", "probability", "similarity"), x, strict=True))
                              for x in out])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(notice))],
                                             names=["_id", "n_paragraphs", "notices"])

    kind = slim.schema["_id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"_id {kind}, n_paragraphs long, notices array<struct<paragraph:int,start:bigint,"
                               "family:string,probability:double,similarity:double>>")
    return out.withColumnRenamed("_id", id_col)
