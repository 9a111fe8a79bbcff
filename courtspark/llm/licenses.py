"""Licence notices in documents by a trained paragraph classifier, scored in DataFrame functions only.

A softmax regression on the words and word pairs of a paragraph tells licence families apart, with a class for
everything else. Paragraphs are the single lines of a text and, for notices broken over lines, the runs of lines between
blank ones (in overlapping pieces of 16 lines, so that any notice of up to 9 lines lies whole in one). It is trained on the templates below (whole, shortened, and inside other text) against a bounded sample
of the corpus's paragraphs; the probability a family needs is set on paragraphs held out from training. A predicted
paragraph is confirmed if it holds enough of the word triples of one of the family's templates.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import lowest, small, stored, text_key, text_or_empty

#: Paragraphs of the corpus that training sees, at most, and the documents they come from.
FIT_PARAGRAPHS, FIT_DOCS = 3_000, 500
#: Share of a template's word triples that confirms a prediction.
CONFIRMED = 0.6
#: Words that tell little about licences.
EVERYDAY = {"a", "and", "any", "by", "for", "in", "is", "of", "or", "person", "the", "this", "to", "with", "without"}
#: Lines of a paragraph read together, at most; pieces start every half of that.
PIECE = 16
#: Slots by which paragraphs without a finding are told, most of them, before they are shuffled.
SLOTS = 1 << 20
#: Share of held-out other paragraphs that may reach the needed probability.
FALSE_ALARMS = 0.001

#: Customary notices of licence families.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "This project is released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "This project is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "This software is released under the BSD 3-Clause License",
        "Licensed under the 2-clause BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Released under the GNU GPL, version 2 or later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC": [
        "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "To view a copy of this license, visit creativecommons.org licenses",
    ],
    "public domain": [
        "This is free and unencumbered software released into the public domain",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "This work has been dedicated to the public domain under CC0 1.0 Universal",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Licensed under the ISC License",
    ],
    "all rights reserved": [
        "All rights reserved",
        "Copyright. All rights reserved",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher",
        "This document is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited",
    ],
}
FAMILIES = list(TEMPLATES)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def _hash(parts: tuple[str, ...]) -> int:
    """What Spark's ``xxhash64`` gives for several strings."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _grams(words: list[str], n: int) -> set[int]:
    return {_hash(tuple(words[i : i + n])) for i in range(len(words) - n + 1)}


def _features(words: list[str]) -> set[int]:
    return _grams(words, 1) | _grams(words, 2)


def train(others: list[str], seed: int = 3, rounds: int = 400, rate: float = 2.0) -> tuple[dict[int, np.ndarray], np.ndarray, float]:
    """(weights of each word or pair for each family, intercepts, probability needed), relative to the class "other".

    ``others`` are paragraphs of the corpus; those that hold most of some template are left out. A fifth of them only
    sets the probability.
    """
    rng = np.random.default_rng(seed)
    triples = [_grams(_words(t), 3) for ts in TEMPLATES.values() for t in ts]
    plain = [w for w in map(_words, others) if w and not any(t and len(t & _grams(w, 3)) >= CONFIRMED * len(t) for t in triples)]
    held, plain = plain[::5], [w for n, w in enumerate(plain) if n % 5]
    rows, y = [], []
    for k, ts in enumerate(TEMPLATES.values()):
        for t in ts:
            words = _words(t)
            for n in range(16):
                own = [w for w in words if n == 0 or len(words) < 5 or rng.random() > 0.08]
                if n % 2 and plain:
                    around = plain[int(rng.integers(len(plain)))]
                    cut = int(rng.integers(len(around) + 1))
                    own = around[:cut] + own + around[cut:]
                rows.append(_features(own))
                y.append(k)
    known = sorted({f for ts in TEMPLATES.values() for t in ts for f in _features(_words(t))})
    number = {f: n for n, f in enumerate(known)}
    # part of a template's words in ordinary text are no notice: such mixtures count as other
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in _words(t)})
    for n in range(600):
        own = [vocabulary[int(i)] for i in rng.integers(len(vocabulary), size=int(rng.integers(1, 5)))]
        around = plain[n % len(plain)] if plain else []
        rows.append(_features(around + own))
        y.append(len(FAMILIES))
    rows += [_features(w) for w in plain]
    y += [len(FAMILIES)] * len(plain)
    x = np.zeros((len(rows), len(known) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, [number[f] for f in r if f in number]] = 1
    x[:, -1] = 1
    scale = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    goal = np.eye(len(FAMILIES) + 1, dtype=np.float32)[y]
    share = goal.sum(axis=0)
    weight = (goal @ (1 / np.maximum(share, 1)))[:, None] * len(rows) / (len(FAMILIES) + 1)
    w = np.zeros((x.shape[1], len(FAMILIES) + 1), np.float32)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (x / scale).T @ (weight * (p - goal)) / len(rows) + 1e-4 * w
    w -= w[:, -1:]
    need = 0.5
    if held:
        z = np.array([sum((w[number[f]] for f in _features(v) if f in number), w[-1]) for v in held])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        need = max(need, float(np.quantile(p[:, :-1].max(axis=1), 1 - FALSE_ALARMS)))
    return {f: w[n, :-1].astype(float) for f, n in number.items()}, w[-1, :-1].astype(float), min(need, 0.99)


def _tokens(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")


def _runs(tokens: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` tokens."""
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    if n == 2:
        return F.zip_with(F.slice(tokens, 1, size), F.slice(tokens, 2, size), lambda a, b: F.xxhash64(a, b))
    pair = F.zip_with(F.slice(tokens, 1, size), F.slice(tokens, 2, size), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(pair, F.slice(tokens, 3, size), lambda p, c: F.xxhash64(p.a, p.b, c))


def _anchors() -> str:
    """A pattern that every lower-case text matches which holds CONFIRMED of a template's triples.

    Words are added, those of most triples still needed first, until less than CONFIRMED of each template's triples
    go without any of them. Words of under six letters and those of everyday texts come last.
    """
    triples = []
    for ts in TEMPLATES.values():
        for t in ts:
            w = _words(t)
            n = 3 if len(w) > 2 else 2
            triples.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    chosen: set[str] = set()
    while True:
        open_ = [free for t in triples if len(free := {g for g in t if not chosen & set(g)}) >= CONFIRMED * len(t)]
        if not open_:
            return "(?<![a-z0-9])(?:" + "|".join(sorted(chosen)) + ")(?![a-z0-9])"
        words = sorted({w for free in open_ for g in free for w in g})
        chosen.add(max(words, key=lambda w: (len(w) > 5, w not in EVERYDAY, sum(w in g for free in open_ for g in free), w)))


def wrapped(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, pos, lines, paragraph): runs of two lines or more between blank lines that may hold a template.

    A run of more than PIECE lines comes in pieces that overlap by half; a piece that another one holds whole with
    more of its run is left out. Lines are joined by a space; ``pos`` is the first one's.
    """
    half = PIECE // 2
    anchors = _anchors()
    some = docs.where(F.lower(text).rlike(anchors)).select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), F.split(text, "\n", -1).alias("all"))
    near = F.filter(F.transform("all", lambda line, i: F.when(F.lower(line).rlike(anchors), F.floor(i / half).cast("int") * half)), lambda i: i.isNotNull())
    some = some.withColumn("near", F.array_distinct(near))
    starts = F.array_distinct(F.concat("near", F.filter(F.transform("near", lambda i: i - half), lambda i: i >= 0)))
    pieces = some.select("doc_id", "text_key", "all", F.explode(starts).alias("start")).withColumn("piece", F.slice("all", F.col("start") + 1, F.lit(PIECE)))
    empty = lambda line: F.trim(F.translate(line, "\t\r\f", "   ")) == ""
    blanks = F.filter(F.transform("piece", lambda line, i: F.when(empty(line), i)), lambda i: i.isNotNull())
    more_above = (F.col("start") > 0) & ~empty(F.coalesce(F.get("all", F.col("start") - 1), F.lit("")))
    more_below = ~empty(F.coalesce(F.get("all", F.col("start") + PIECE), F.lit("")))
    pieces = pieces.select("doc_id", "text_key", "start", "piece", more_above.alias("above"), more_below.alias("below"), blanks.alias("blank"))
    runs = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("blank", lambda i: i + 1)).alias("lo"), F.concat("blank", F.array(F.size("piece"))).alias("hi"))
    runs = pieces.select("doc_id", "text_key", "start", "piece", "above", "below", F.explode(runs).alias("run")).select("*", F.col("run.lo").alias("lo"), F.col("run.hi").alias("hi"))
    elsewhere = (F.col("above") & (F.col("lo") == 0) & (F.col("hi") <= half)) | (F.col("below") & (F.col("hi") == PIECE) & (F.col("lo") >= half))
    runs = runs.where((F.col("hi") - F.col("lo") > 1) & ~elsewhere).withColumn("paragraph", F.array_join(F.slice("piece", F.col("lo") + 1, F.col("hi") - F.col("lo")), " "))
    return runs.where(F.lower("paragraph").rlike(anchors)).select("doc_id", "text_key", (F.col("start") + F.col("lo")).alias("pos"), (F.col("hi") - F.col("lo")).alias("lines"), "paragraph")


def paragraphs(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, pos, paragraph): the lines of each text; a null text is one empty line."""
    body = text_or_empty(text)
    return docs.select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "paragraph"))


def scanned(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, pos, lines, family, probability, template, coverage, confirmed): a row per paragraph with a licence.

    Paragraphs are lines (``lines`` 1) and runs of lines (see ``wrapped``). A run is reported only if a template confirms
    it that no single line of it holds already. Rows that share id and text are one document. ``template`` is the
    family's best covered notice, the last in the alphabet of equals; of equally likely families the first one listed
    counts. A null or empty text has no row; a corpus without text gives an empty result. Texts of any length are read
    whole.
    """
    spark = docs.sparkSession
    rows = docs.where(F.length(text) > 0).select(F.struct(F.col(id).alias("id"), text_key(text).alias("key")).alias("row"), F.col(text).alias("body"))
    some = lowest(rows, F.col("row"), FIT_DOCS, rows.count())
    sample = paragraphs(some, "body", "row").where("length(paragraph) > 0").orderBy(F.xxhash64("paragraph"), "paragraph").limit(FIT_PARAGRAPHS)
    weights, base, need = train([r[0] for r in sample.select(F.substring("paragraph", 1, 5_000)).collect()])

    # both tables are as large as the templates, whatever the corpus
    scores = F.broadcast(spark.createDataFrame([(f, [float(v) for v in w]) for f, w in sorted(weights.items())], "gram long, w array<double>"))
    notices = [(k, t, sorted(_grams(_words(t), 3) or _grams(_words(t), 2))) for k, ts in TEMPLATES.items() for t in ts]
    notices = F.broadcast(spark.createDataFrame(notices, "family string, template string, triples array<long>"))

    cut = paragraphs(docs, text, id).select("doc_id", "text_key", "pos", F.lit(1).alias("lines"), "paragraph").unionByName(stored(wrapped(docs, text, id), "runs"))
    tokens = cut.withColumn("tokens", _tokens(F.col("paragraph"))).where(F.size("tokens") > 1)
    grams = F.array_distinct(F.concat(F.transform("tokens", lambda w: F.xxhash64(w)), _runs(F.col("tokens"), 2)))
    hits = tokens.select("doc_id", "text_key", "pos", "lines", F.explode(grams).alias("gram")).join(scores, "gram")
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(FAMILIES))]
    # a paragraph of a repeated row would count twice: the number of rows it stands for divides it out
    again = rows.groupBy(F.col("row.id").alias("again_id"), F.col("row.key").alias("again_key")).agg(F.count("*").alias("copies")).where("copies > 1")
    again = small(stored(again, "repeated-rows"))
    z = hits.groupBy("doc_id", "text_key", "pos", "lines").agg(*sums)
    z = z.join(again, F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("text_key") == F.col("again_key")), "left")
    logits = F.array(*((F.col(f"s{k}") / F.coalesce("copies", F.lit(1)) + float(base[k])) for k in range(len(FAMILIES))))
    z = z.select("doc_id", "text_key", "pos", "lines", logits.alias("z"))
    top = F.greatest(F.array_max("z"), F.lit(0.0))
    total = F.aggregate("z", F.exp(-top), lambda acc, v: acc + F.exp(v - top))
    z = z.withColumn("probability", F.exp(F.array_max("z") - top) / total).where(F.col("probability") >= need)
    found = z.select("doc_id", "text_key", "pos", "lines", F.array(*map(F.lit, FAMILIES))[F.array_position("z", F.array_max("z")).cast("int") - 1].alias("family"), "probability")
    found = stored(found, "licences")

    own = F.col("p.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("p.text_key") == F.col("f.text_key")) & (F.col("p.pos") == F.col("f.pos")) & (F.col("p.lines") == F.col("f.lines"))
    # one plan for all sizes: what is found grows with the documents
    # only paragraphs that share a slot with one found are shuffled; the slots are of bounded number, the join stays exact
    slot = F.pmod(F.xxhash64("doc_id", "text_key", "pos", "lines"), F.lit(SLOTS)).alias("slot")
    slots = F.broadcast(found.select(slot).distinct())
    likely = cut.select("*", slot).join(slots, "slot", "left_semi").drop("slot")
    seen = likely.alias("p").join(found.hint("merge").alias("f"), own).select("f.*", "p.paragraph").dropDuplicates(["doc_id", "text_key", "pos", "lines"])
    triples = F.concat(_runs(F.col("tokens"), 3), _runs(F.col("tokens"), 2))
    seen = seen.withColumn("tokens", _tokens(F.col("paragraph"))).withColumn("own", triples).join(notices, "family")
    covered = F.size(F.array_intersect("triples", "own")) / F.size("triples")
    best = seen.groupBy("doc_id", "text_key", "pos", "lines", "family", "probability").agg(F.max(F.struct(covered.alias("coverage"), "template")).alias("best"))
    best = best.select("doc_id", "text_key", "pos", "lines", "family", "probability", "best.template", "best.coverage", (F.col("best.coverage") >= CONFIRMED).alias("confirmed"))
    best = stored(best, "notices")
    one, more = best.where("lines = 1"), best.where("lines > 1 AND confirmed")
    inside = F.col("m.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("m.text_key") == F.col("o.text_key")) & (F.col("m.template") == F.col("o.template"))
    inside = inside & (F.col("o.pos") >= F.col("m.pos")) & (F.col("o.pos") < F.col("m.pos") + F.col("m.lines"))
    return one.unionByName(more.alias("m").join(one.where("confirmed").alias("o"), inside, "left_anti"))
