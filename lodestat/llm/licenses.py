"""Licence scans: a trained paragraph classifier whose findings templates confirm.

A paragraph is what stands between lines without words. Read are each line of
it (a line of more than LONGEST words in windows that overlap by half), the
WINDOW words from the beginning of each line on, across line ends and comment
marks, and the whole paragraph if it has at most LONGEST words; of findings
of a family that overlap, the one with the best share stays. Its features are word 1- to 3-grams (runs of letters and
digits, lower case), hashed, scaled by the root of their number. A multinomial
logistic regression with one class per licence family and one for unknown is
trained in numpy on the notices below, worn by dropped words and text around
them, against paragraphs of the corpus itself and sentences that only speak of
licences. A temperature fitted on held-out examples calibrates its
probabilities; a paragraph whose best family stays under LEAST, or of whose
notices it holds next to nothing, is unknown. A finding is confirmed if the paragraph holds enough of the word pairs of one
of the family's notices.

Defined results: null and empty texts have no paragraphs and no rows; repeated
rows give repeated findings; an empty table gives an empty result. Only doc_id
and text are read. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import durable

#: Short notices as projects print them.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "gpl-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPLv3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPLv3."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "This work is dedicated to the public domain."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."],
}
#: Sentences that speak of licences and grant none.
NOT_NOTICES = [
    "He renewed his driving license in the spring.", "The court heard the copyright dispute last week.", "A fishing license is required at the lake.",
    "The version of the report was released in May.", "Members of the public are welcome.", "The general was granted permission to speak.",
    "All seats are reserved for guests.", "Under the bridge the work went on.", "The Apache helicopter landed at noon.", "She studied at MIT for four years.",
]

GRAMS, SLOTS, LONGEST, WINDOW = 3, 1 << 16, 80, 40
#: Bounds and limits: corpus texts read for the unknown class; probability of a finding; share of a notice's word pairs that confirms it; under the last, what the classifier says is left unknown.
TEXTS, PARAGRAPHS, LEAST, CONFIRMING, FAINT = 1_000, 3_000, 0.6, 0.6, 0.2


def _units(data: np.ndarray, at: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, one past the last, and whether it is more than one line, of each unit, by the place of words and the bytes they begin at."""
    breaks = np.searchsorted(firsts, np.flatnonzero(data == 0x0A))
    blank = breaks[1:][breaks[1:] == breaks[:-1]]  # two line breaks without a word between them
    cuts, stops = np.unique(np.concatenate([at, breaks])), np.unique(np.concatenate([at, blank]))
    s, e = cuts[:-1], cuts[1:]
    long_ = e - s > LONGEST
    begins, ends = [s[~long_]], [e[~long_]]
    for a, b in zip(s[long_], e[long_], strict=True):
        w = np.arange(a, b - WINDOW // 2, WINDOW // 2)
        begins.append(w)
        ends.append(np.minimum(w + WINDOW, b))
    lines = sum(map(len, begins))
    end = stops[np.searchsorted(stops, s, side="right")]  # of the paragraph that a line is in
    some = ~long_ & (np.minimum(end, s + WINDOW) > e)
    begins.append(s[some])
    ends.append(np.minimum(end, s + WINDOW)[some])
    whole = (end - s <= LONGEST) & (end > np.maximum(e, s + WINDOW)) & np.isin(s, stops)
    begins.append(s[whole])
    ends.append(end[whole])
    s, e = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(s, kind="stable")
    return s[order], e[order], (np.arange(len(s)) >= lines)[order]


def _clear(said: str) -> str:
    """said without lines at its end that hold no word."""
    said = said.rstrip()
    while "\n" in said and not re.search(r"[^\W_]", said[said.rindex("\n") :]):
        said = said[: said.rindex("\n")].rstrip()
    return said


class _Hit(NamedTuple):
    share: float
    start: int
    end: int
    family: str
    probability: float
    said: str


def merged(hits: list[_Hit]) -> list[_Hit]:
    """Of hits of one family that overlap, the one with the best share, then the shortest; words inside a confirmed finding speak for no other family."""
    kept: list[_Hit] = []
    for hit in sorted(hits, key=lambda h: (-h.share, h.end - h.start, h.start, h.family)):
        over = [k for k in kept if k.start < hit.end and k.end > hit.start]
        if any(k.family == hit.family for k in over):
            continue
        if sure := [k for k in over if k.share >= CONFIRMING]:
            said = "".join(c for i, c in enumerate(hit.said, hit.start) if not any(k.start <= i < k.end for k in sure))
            hit = hit._replace(share=max(held(said, n) for n in NOTICES[hit.family]))
            if hit.share < FAINT:
                continue
        kept.append(hit)
    return sorted(kept, key=lambda h: (h.start, h.end, h.family))


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """Slot of the n-gram that begins at each word, for n from 1."""
    out, total = [], np.zeros(len(hashes), np.uint64)
    for n in range(GRAMS):
        total = textvec.mix(total[: len(hashes) - n] * np.uint64(0x100000001B3) + hashes[n:]) if n else textvec.mix(hashes)
        out.append((total & np.uint64(SLOTS - 1)).astype(np.int64))
    return out


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, bounds, root of the number of n-grams) of whole texts, for training."""
    part = pc.utf8_lower(pa.array(texts, pa.string()))
    data, bounds = textvec.raw(part)
    hashes, _, at = textvec.words(data, bounds, letters=True)
    grams, lists = _slots(hashes), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        lists.append(np.concatenate([g[a : max(a, b - n)] for n, g in enumerate(grams)]))
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([*lists, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum(sizes)]), np.sqrt(np.maximum(sizes, 1))


class Model(NamedTuple):
    families: list[str]
    weights: np.ndarray  # slots x classes, the last class unknown
    intercept: np.ndarray
    temperature: float


def _worn(rng: np.random.Generator, text: str, noise: list[str]) -> str:
    words = text.split()
    if len(words) > 4:
        words = [w for w in words if rng.random() > 0.08] or words
    extra = [noise[i] for i in rng.integers(0, len(noise), rng.integers(0, 25))] if noise and rng.random() < 0.5 else []
    return " ".join([*words, *extra] if rng.random() < 0.5 else [*extra, *words])


def train(paragraphs: list[str], seed: int = 11, copies: int = 40, steps: int = 80, rate: float = 0.5) -> Model:
    """paragraphs: of the corpus; those that hold a notice are left out of the unknown class."""
    rng = np.random.default_rng(seed)
    families = sorted(NOTICES)
    plain = [p for p in paragraphs if max((held(p, n) for f in families for n in NOTICES[f]), default=0) < CONFIRMING]
    noise = [w for p in plain[:400] for w in p.split()]
    texts, y = [], []
    for i, f in enumerate(families):
        for notice in NOTICES[f]:
            texts += [notice] * 5 + [_worn(rng, notice, noise) for _ in range(copies)]
            y += [i] * (5 + copies)
    unknown = plain + [_worn(rng, t, noise) for t in NOT_NOTICES for _ in range(copies)]
    texts, y = texts + unknown, np.array(y + [len(families)] * len(unknown))
    slots, bounds, root = _rows(texts)
    hold = rng.random(len(y)) < 0.2
    classes = len(families) + 1
    balance = np.bincount(y[~hold], minlength=classes).astype(float)
    weight = np.where(hold, 0.0, (1 / np.sqrt(np.maximum(balance, 1)))[y])
    weight /= weight.sum()
    used, place = np.unique(slots, return_inverse=True)
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    m, v = np.zeros((len(used) + 1, classes)), np.zeros((len(used) + 1, classes))
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    by_place = np.argsort(place, kind="stable")
    begins = np.searchsorted(place[by_place], np.arange(len(used)))
    row_of = row[by_place]
    some = np.diff(bounds) > 0

    def logits() -> np.ndarray:
        sums = np.zeros((len(y), classes), np.float32)
        sums[some] = np.add.reduceat(w.astype(np.float32)[place], bounds[:-1][some], axis=0)
        return sums / root[:, None] + b

    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    for t in range(1, steps + 1):
        slope = softmax(logits())
        slope[np.arange(len(y)), y] -= 1
        slope *= weight[:, None]
        g = np.zeros((len(used) + 1, classes))
        g[:-1] = np.add.reduceat((slope / root[:, None]).astype(np.float32)[row_of], begins, axis=0)
        g[:-1] += 1e-6 * w
        g[-1] = slope.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    z = logits()[hold]
    loss = lambda q: -np.log(softmax(z / q)[np.arange(len(z)), y[hold]] + 1e-12).mean()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    weights = np.zeros((SLOTS, classes), np.float32)
    weights[used] = w
    return Model(families, weights, b, float(temperature))


def _pairs(text: str) -> set[tuple[str, ...]]:
    w = re.findall(r"[^\W_]+", text.lower())
    return {*zip(w, w[1:], strict=False)} or {tuple(w)}


def held(paragraph: str, notice: str) -> float:
    """Share of the notice's word pairs that the paragraph holds."""
    own = _pairs(notice)
    return len(own & _pairs(paragraph)) / len(own)


FINDINGS = "doc_id long, start int, end int, family string, probability double, confirmed boolean, held double"


def scan(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """One row per paragraph that the classifier gives to a family: place, family, probability, and whether a notice confirms it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_()), ("held", pa.float64())])
    families, weights, intercept, temperature = model

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower = pc.utf8_lower(batch.column("text"))
            for at, part in textvec.pieces(lower):
                data, bounds = textvec.raw(part)
                hashes, firsts, of = textvec.words(data, bounds, letters=True)
                s, e, lines = _units(data, of, firsts)
                sums, many = np.zeros((len(s), len(intercept))), np.zeros(len(s))
                for n, slots in enumerate(_slots(hashes)):
                    run = np.concatenate([np.zeros((1, len(intercept))), np.cumsum(weights[slots], axis=0, dtype=np.float64)])
                    stop = np.maximum(e - n, s)
                    sums += run[np.minimum(stop, len(slots))] - run[np.minimum(s, len(slots))]
                    many += stop - s
                z = (sums / np.sqrt(np.maximum(many, 1))[:, None] + intercept) / temperature
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p[:, :-1].argmax(axis=1) if len(p) else np.zeros(0, np.int64)
                hits = np.flatnonzero((p[np.arange(len(p)), best] >= least) & (many > 0))
                found: dict[int, list[_Hit]] = {}
                for i in hits.tolist():
                    text = int(np.searchsorted(of, s[i], side="right")) - 1
                    whole = data[bounds[text] : bounds[text + 1]].tobytes()
                    a = int(firsts[s[i]] - bounds[text])
                    z_ = int(firsts[e[i]] - bounds[text]) if e[i] < of[text + 1] else len(whole)
                    said = _clear(whole[a:z_].decode()) if lines[i] else whole[a:z_].split(b"\n")[0].decode().rstrip()
                    family = families[best[i]]
                    share = max(held(said, notice) for notice in NOTICES[family])
                    if share >= FAINT:
                        begin = len(whole[:a].decode())
                        found.setdefault(text, []).append(_Hit(share, begin, begin + len(said), family, float(p[i, best[i]]), said))
                rows = [(batch.column("doc_id")[at + text].as_py(), h.start, h.end, h.family, h.probability, h.share >= CONFIRMING, h.share) for text, own in sorted(found.items()) for h in merged(own)]
                columns = list(zip(*rows, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return durable(lean.mapInArrow(scanned, FINDINGS), "licences")


def fit(docs: DataFrame, texts: int = TEXTS, paragraphs: int = PARAGRAPHS) -> Model:
    """Train with the paragraphs of a bounded sample of texts, the first by a hash of their ids, for the unknown class."""
    ids = docs.where("text is not null and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    chosen = durable(ids, "ids")  # bounded, so it may be broadcast
    lines = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.where("length(trim(line)) > 0").orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n", "line").limit(paragraphs)
    return train([" ".join(r["line"].split()[:LONGEST]) for r in lines.select("line").collect()])
