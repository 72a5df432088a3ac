"""Toxicity by non-negative positive-unlabelled learning.

Few texts are confirmed toxic and the rest are unlabelled, toxic ones among
them. With p the share of toxic texts, the risk over the unlabelled ones as if
all were clean counts the toxic ones wrongly; p times the risk of the
confirmed ones as if clean corrects that, and the difference, a risk, is kept
from falling below 0 as a flexible model would drive it:

    p E+[l(z)] + max(0, E[l(-z)] - p E+[l(-z)]),   l(z) = ln(1 + exp(-z))

The model is linear over the presence of words (runs of letters and digits,
lower case) and of their first bytes, hashed, trained in numpy by Adam; only
features that toxic texts hold more often than not, with evidence beyond
chance, are kept, so that weak ones don't add up over a long text; common and
rare words are held to the same test. How weak a weight may be is chosen on a
fold of the rows learned from. Where the second part is negative a step undoes
it instead. p is the share of toxic rows among the labels learned from (half a
row more of either kind, so that it is never 0 or 1).

Defined results: null text is empty; a text without known words gets the score
of the intercept. Without both a confirmed text and labels, every score is p.
Repeated rows get the same score; of an id with several texts the least is
learned from. A null doc_id is scored and not held out.
Labels, language, source and ids are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import durable, labelled, learned_from

#: Bounds of the samples that the classifier is fitted on: confirmed texts, unlabelled texts, labels.
POSITIVES, UNLABELLED, LABELS = 4_000, 8_000, 100_000
PREFIXES = (4, 5, 6)
#: Features kept at most; confirmed texts that hold one at least; share of toxic ones, by p, among the texts that hold one; features that chance alone may pass as evident.
FEATURES, LEAST_TEXTS, LEAST_SHARE, BY_CHANCE = 8_192, 4, 0.6, 1.0
#: After a first fit, features under one of these shares of the largest weight go and the rest are fitted again: the share that does best on a fold of the rows learned from.
LEAST_WEIGHTS = (0.3, 0.2, 0.1, 0.0)
THRESHOLD = 0.5


def _hashes(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit features and the number of the text of each, as they come."""
    found = textvec.words(*textvec.raw(part), letters=True, prefixes=PREFIXES)
    text = np.repeat(np.arange(len(part)), np.diff(found[2]))
    every = [found[0], *found[3:]]
    keep = [h != 0 for h in every]
    return np.concatenate([h[k] for h, k in zip(every, keep, strict=True)]), np.concatenate([text[k] for k in keep])


_SAMPLE = pa.schema([("y", pa.int32()), ("truth", pa.int32()), ("fold", pa.int32()), ("f", pa.list_(pa.int32()))])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.utf8_lower(batch.column("text"))
        for at, part in textvec.pieces(texts):
            h, text = _hashes(part)
            code = np.unique((text.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
            of = (code >> np.uint64(32)).astype(np.int64)
            flat = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
            f = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(part)).cast(pa.int32()) for c in ("__y", "truth", "fold")], pa.ListArray.from_arrays(pa.array(flat), pa.array(f))], schema=_SAMPLE)


def _known_only(names: np.ndarray):
    """Rows of a sample with the features of names (ascending) alone."""
    wanted = names.astype(np.uint32)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("f")
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy().view(np.uint32)
            keep = np.isin(flat, wanted)
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            bounds = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("y", "truth", "fold")], pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat[keep].view(np.int32)))], schema=_SAMPLE)

    return known


def non_negative_pu(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], size: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept. Each sample: features (places below size) and the row bounds into them."""

    def scores(sample, w, b):
        sums = np.concatenate([[0.0], np.cumsum(w[sample[0]])])
        return sums[sample[1][1:]] - sums[sample[1][:-1]] + b

    def gradient(sample, slopes):
        rows = np.repeat(slopes, np.diff(sample[1]))
        return np.append(np.bincount(sample[0], rows, minlength=size), slopes.sum())

    def sigmoid(z):
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    x, m, v = np.append(np.zeros(size), np.log(prior / (1 - prior))), np.zeros(size + 1), np.zeros(size + 1)
    n_p, n_u = len(positive[1]) - 1, len(unlabelled[1]) - 1
    for t in range(1, steps + 1):
        z_p, z_u = scores(positive, x[:-1], x[-1]), scores(unlabelled, x[:-1], x[-1])
        clean = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        g_clean = gradient(unlabelled, sigmoid(z_u) / n_u) - prior * gradient(positive, sigmoid(z_p) / n_p)
        g = -g_clean if clean < 0 else prior * gradient(positive, (sigmoid(z_p) - 1) / n_p) + g_clean
        g[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes (ascending), their weights and the intercept, from bounded samples of the rows that may be learned from."""
    known = durable(labelled(labels, "toxic", LABELS), "labels")
    shares = known.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("p")).first()
    prior = ((shares["p"] or 0) + 0.5) / (shares["n"] + 1)
    nothing = np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior)))
    if not shares["p"]:
        return nothing
    confirmed = known.where("__y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(1).alias("__y"))
    other = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).distinct()
    other = other.orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("__y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)).cast("int")
    chosen = confirmed.unionByName(other).join(known.withColumnRenamed("__y", "truth"), "doc_id", "left").withColumn("fold", fold)
    chosen = durable(chosen, "chosen")  # bounded, so it may be broadcast
    texts = learned_from(docs, chosen.where("__y = 1")).unionByName(learned_from(docs, chosen.where("__y = 0")))
    texts = texts.groupBy("text", "__y").agg(F.max("truth").alias("truth"), F.min("fold").alias("fold"))  # copies count once
    sample = durable(texts.mapInArrow(_sampled, "y int, truth int, fold int, f array<int>"), "sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return nothing
    counts = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u")).where(F.col("p") >= LEAST_TEXTS)
    p, u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    # log likelihood ratio of a feature's texts being divided as they are, against by the sizes of both samples
    both, share = F.col("p") + F.col("u"), n_p / (n_p + n_u)
    evidence = F.col("p") * F.log(F.col("p") / (both * share)) + F.when(F.col("u") > 0, F.col("u") * F.log(F.col("u") / (both * (1 - share)))).otherwise(0.0)
    counts = durable(counts.withColumn("evidence", evidence), "counts")
    least = math.log(max(counts.count(), 1) / BY_CHANCE)
    best = counts.where((F.col("evidence") >= least) & (prior * p >= LEAST_SHARE * u)).orderBy(F.desc("evidence"), "f").limit(FEATURES).select("f").collect()
    names = np.sort(np.array([r["f"] for r in best], np.int32).view(np.uint32))
    if not len(names):
        return nothing
    # what comes to the driver is bounded by the texts of the sample and the features kept
    rows = sample.mapInArrow(_known_only(names), "y int, truth int, fold int, f array<int>").toArrow()
    column = rows.column("f").combine_chunks()
    place = np.searchsorted(names, column.flatten().to_numpy().view(np.uint32))
    row = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    y, folds = rows.column("y").to_numpy(), rows.column("fold").to_numpy()
    truth = pc.fill_null(rows.column("truth"), -1).to_numpy()
    # the same weights whatever order the rows came in
    order = np.lexsort((np.bincount(row, names[place].astype(np.float64) ** 0.5, minlength=len(y)), np.bincount(row, minlength=len(y)), folds, truth, y))
    at = np.empty(len(y), np.int64)
    at[order] = np.arange(len(y))
    again = np.lexsort((place, at[row]))
    place, row, y, folds, truth = place[again], at[row][again], y[order], folds[order], truth[order]

    def fitted(use: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Features kept, their weights and the intercept, from the rows that use marks."""
        good, weights, intercept = np.arange(len(names)), np.zeros(0), nothing[2]
        for last in (False, True):
            new = np.full(len(names), -1)
            new[good] = np.arange(len(good))
            kept = (new[place] >= 0) & use[row]

            def part(label: int) -> tuple[np.ndarray, np.ndarray]:
                of = np.flatnonzero((y == label) & use)
                renumbered = np.full(len(y), -1)
                renumbered[of] = np.arange(len(of))
                here = kept & (y[row] == label)
                return new[place[here]], np.searchsorted(renumbered[row[here]], np.arange(len(of) + 1))

            # few features are left for the second fit, which may therefore follow the data closer
            weights, intercept = non_negative_pu(part(1), part(0), len(good), prior, decay=2e-5 if last else 2e-4)
            if not last:
                good = good[weights >= least * weights.max(initial=0.0)]
        return good, weights, intercept

    def loss(least: float) -> float:
        """Of the rows of one fold whose labels are known, from a fit on the others: toxic and clean rows each by their share."""
        good, weights, intercept = fitted(folds != 0, least)
        w = np.zeros(len(names))
        w[good] = weights
        z = np.bincount(row, w[place], minlength=len(y)) + intercept
        parts = [(prior if label else 1 - prior) * np.logaddexp(0, -z[some] if label else z[some]).mean() for label in (0, 1) if (some := (folds == 0) & (truth == label)).any()]
        return float(sum(parts))

    least = min(LEAST_WEIGHTS, key=loss) if (folds != 0).any() and len({*y[folds != 0].tolist()}) == 2 else LEAST_WEIGHTS[1]
    good, weights, intercept = fitted(np.ones(len(y), bool), least)
    return names[good], weights, intercept


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    names, weights, intercept = model
    table = np.zeros(1 << 20, bool)
    table[names & np.uint32((1 << 20) - 1)] = True
    packed = np.packbits(table).tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            texts = pc.utf8_lower(batch.column("text"))
            for at, part in textvec.pieces(texts):
                h, text = _hashes(part)
                h = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                may = known[h & np.uint32((1 << 20) - 1)]
                h, text = h[may], text[may]
                place = np.minimum(np.searchsorted(names, h), max(len(names) - 1, 0))
                hit = names[place] == h if len(names) else np.zeros(0, bool)
                code = np.unique(text[hit].astype(np.int64) * max(len(names), 1) + place[hit])
                z = intercept + np.bincount(code // max(len(names), 1), weights[code % max(len(names), 1)] if len(names) else None, minlength=len(part))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))))], schema=schema)

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(lean.mapInArrow(score, "doc_id long, score double"), "scores")
    return rows.select("doc_id", held_out(), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
