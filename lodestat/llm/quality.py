"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are binned by their quantiles once; each tree is grown level by
level from histograms of gradients, to a fixed depth, so a forest is three
arrays (feature, threshold, leaf value) in heap order and scoring walks all
trees of all rows at once: place = 2 * place + 1 + (x > threshold).

Defined results: null text is empty; empty texts have statistics of 0 and are
scored like others. Without labels of both classes, every score is the share
of label 1 (0.5 without labels). Repeated rows get the same score; of an id
with several texts the least is learned from. A null
doc_id is scored and not held out. Labels, language, source and ids are never
inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import durable, labelled, learned_from
from .toxicity import held_out

#: Bound of the labelled sample that the trees are fitted on.
LABELS = 20_000
THRESHOLD = 0.3

STATISTICS = ("words", "bytes_per_word", "upper", "digits", "symbols", "marks", "points", "beyond_ascii", "spaces", "lines", "distinct", "most_common", "adjacent", "repeated")
_CLASSES = {
    "upper": [*range(0x41, 0x5B)], "digits": [*range(0x30, 0x3A)], "symbols": [*b"#*$%&|<>"], "marks": [*b"!?~^_=+@/\\"],
    "points": [*b".,;:'\"()-"], "beyond_ascii": [*range(0x80, 0x100)], "spaces": [0x20, *range(0x09, 0x0E)], "lines": [0x0A],
}


def statistics(part: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, bounds = textvec.raw(part)
    hashes, _, at = textvec.words(data, bounds)
    n, counts = len(part), np.diff(at)
    size = np.maximum(np.diff(bounds), 1)
    out = np.zeros((n, len(STATISTICS)))
    place = {s: i for i, s in enumerate(STATISTICS)}
    out[:, place["words"]] = np.log1p(counts)
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[members] = True
        sums = np.concatenate([[0], np.cumsum(table[data])])
        out[:, place[name]] = (sums[bounds[1:]] - sums[bounds[:-1]]) / size
    some = np.maximum(counts, 1)
    out[:, place["bytes_per_word"]] = np.diff(bounds) * (1 - out[:, place["spaces"]]) / some
    text = np.repeat(np.arange(n), counts)
    if len(hashes):
        order = np.lexsort((hashes, text))
        h, t = hashes[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        starts = np.flatnonzero(new)
        many = np.diff(np.append(starts, len(h)))
        top = np.zeros(n)
        np.maximum.at(top, t[starts], many)
        # distinct words fall with length by themselves; the power takes most of that out
        out[:, place["distinct"]] = np.bincount(t[starts], minlength=n) / some**0.9
        out[:, place["most_common"]] = top / some
        same = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        out[:, place["adjacent"]] = np.bincount(text[1:][same], minlength=n) / some
        runs, of = textvec.shingles(hashes, at, 8)
        order = np.lexsort((runs, of))
        r, o = runs[order], of[order]
        again = (r[1:] == r[:-1]) & (o[1:] == o[:-1])
        out[:, place["repeated"]] = np.bincount(o[1:][again], minlength=n) / some
    return out


class Forest(NamedTuple):
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            trees, inner = self.feature.shape
            depth = inner.bit_length()
            t, rows = np.arange(trees)[None, :], np.arange(len(x))[:, None]
            place = np.zeros((len(x), trees), np.int64)
            for _ in range(depth):
                place = 2 * place + 1 + (x[rows, self.feature[t, place]] > self.threshold[t, place])
            z += self.value[t, place - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Logistic loss; gains from histograms; leaves shrunk by ridge and rate."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, (c[1:] + c[:-1]) / 2])) for c in cuts]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    z = np.full(len(y), base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        place = np.zeros(len(y), np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            best, chosen = np.zeros(nodes), np.full((nodes, 2), -1)
            for j in range(x.shape[1]):
                cell = (place - first) * width + codes[:, j]
                gs, hs, ns = (np.bincount(cell, w, minlength=nodes * width).reshape(nodes, width).cumsum(axis=1) for w in (g, h, np.ones(len(y))))
                left, right = (gs[:, :-1], hs[:, :-1]), (gs[:, -1:] - gs[:, :-1], hs[:, -1:] - hs[:, :-1])
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain[(ns[:, :-1] < least) | (ns[:, -1:] - ns[:, :-1] < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > best + 1e-12
                best[better], chosen[better] = top[better], np.stack([np.full(nodes, j), at], axis=1)[better]
            for i in np.flatnonzero(chosen[:, 0] >= 0):
                j, at = chosen[i]
                feature[k, first + i], threshold[k, first + i] = j, cuts[j][at]
            place = 2 * place + 1 + (x[np.arange(len(y)), feature[k, place]] > threshold[k, place])
        leaf = place - inner
        value[k] = rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + ridge)
        z += value[k, leaf]
    return Forest(feature, threshold, value, base)


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELS) -> Forest:
    chosen = labelled(labels, "quality", bound)
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in textvec.pieces(batch.column("text")):
                x = statistics(part)
                yield pa.RecordBatch.from_arrays([batch.column("__y").slice(at, len(part)).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], schema=schema)

    sample = durable(learned_from(docs, chosen).select("__y", "text").mapInArrow(rows, "y int, x array<double>"), "sample").toArrow()
    y = sample.column("y").to_numpy().astype(np.float64)
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(STATISTICS))
    order = np.lexsort((y, *x.T))  # the same trees whatever order the rows came in
    return boost(x[order], y[order])


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in textvec.pieces(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(forest.scores(statistics(part)))], schema=schema)

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(lean.mapInArrow(score, "doc_id long, score double"), "scores")
    return rows.select("doc_id", held_out(), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
