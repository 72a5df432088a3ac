"""Trees, forests and networks learned from counted rows: rows that are alike in every feature are one cell with their numbers by class.

Nothing is left out: sums over rows are sums over cells, and a bootstrap of n
like rows, each drawn Poisson(1) times, is one Poisson(n). Frames of more than
CELLS cells give None, and the caller takes Spark ML over all rows instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that the driver and each task hold; beyond, Spark ML learns from rows.
CELLS = 50_000
#: The column of how many rows a cell has; entries of a table that a shuffle draws, and rows, at most: numpy's limits.
TIMES, ENTRIES, DRAWN_ROWS = "cell_n", 20_000_000, 1_000_000_000


def counted(rows: DataFrame, label: str, columns: Sequence[str], make) -> tuple[np.ndarray, np.ndarray] | None:
    """(x of each cell, its rows of class 0 and 1) of all rows; None beyond CELLS."""
    every = rows.groupBy(*columns, F.col(label).cast("double").alias("cell_y")).agg(F.count(F.lit(1)).alias("cell_n"))
    got = make(every).select(vector_to_array("x").alias("x"), "cell_y", "cell_n").limit(CELLS + 1).toArrow().combine_chunks()  # one more tells that there are too many
    if not 0 < got.num_rows <= CELLS:
        return None
    x = np.array(got.column("x").to_pylist(), dtype="d")
    x, of = np.unique(x, axis=0, return_inverse=True)
    n = np.zeros((len(x), 2))
    np.add.at(n, (of.ravel(), got.column("cell_y").to_numpy().astype(int)), got.column("cell_n").to_numpy())
    return x, n


def tally(df: DataFrame, columns: Sequence[str]) -> pa.Table | None:
    """Distinct values of the columns and how many rows have them; None if those are too many to hold or to draw from."""
    got = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(TIMES)).limit(CELLS + 1).toArrow().combine_chunks()  # one more tells that there are too many
    return got if 0 < got.num_rows <= CELLS and sum(got.column(TIMES).to_pylist()) < DRAWN_ROWS else None


def dealt(counted: pa.Table, column: str, seed) -> pa.Table | None:
    """counted with the column's values shuffled between all rows; None if the table is too large to draw."""

    def numbered(names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        known: dict[tuple, int] = {}
        of = np.array([known.setdefault(row, len(known)) for row in zip(*[counted.column(c).to_pylist() for c in names], strict=True)])
        return of, np.unique(of, return_index=True)[1]

    (rest, first_rest), (value, first_value) = numbered([c for c in counted.column_names if c not in (column, TIMES)]), numbered([column])
    n = counted.column(TIMES).to_numpy()
    sides = [np.bincount(of, n).astype(np.int64) for of in (rest, value)]
    if len(sides[0]) * len(sides[1]) > ENTRIES:
        return None
    rng, few = np.random.default_rng(seed), int(len(sides[0]) > len(sides[1]))
    left, found = sides[1 - few].copy(), []
    for i, m in enumerate(sides[few]):  # each takes its number of rows out of those that are left
        got = rng.multivariate_hypergeometric(left, m, method="marginals")
        left -= got
        j = np.flatnonzero(got)
        found.append((np.full(len(j), i), j, got[j]))
    a, b, times = (np.concatenate(z) for z in zip(*found, strict=True))
    at, v = (b, a) if few else (a, b)
    out = counted.take(first_rest[at])
    out = out.set_column(out.column_names.index(column), counted.schema.field(column), counted.column(column).take(first_value[v]))
    return out.set_column(out.column_names.index(TIMES), TIMES, pa.array(times, pa.int64()))


def edges(x: np.ndarray, n: np.ndarray, most: int) -> list[np.ndarray]:
    """Ends between bins of each feature: between all neighbouring values if they are few, else at quantiles of the rows."""
    out = []
    for column in x.T:
        values, of = np.unique(column, return_inverse=True)
        between = (values[1:] + values[:-1]) / 2
        if len(values) > most:
            upto = np.cumsum(np.bincount(of.ravel(), n))
            at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, most) / most))
            between = between[at[at < len(between)]]
        out.append(between)
    return out


def _grower():
    def grow(bins, sizes, w, s, n, depth, least, some=None, rng=None):
        """A tree by weighted variance (half of Gini's impurity for targets 0 and 1), level by level: arrays feature (-1: leaf), bin (below or at it: left), left (right is next), value; each cell's value; what each feature gained.
        w, s, n: weight, weighted target and number of each cell's rows. some: features that a node may use, drawn by rng."""
        cells = np.flatnonzero(w > 0)
        feature, cut, left, value = [], [], [], []
        at, first, wide, gained, out = np.zeros(len(cells), dtype=np.int64), 0, 1, np.zeros(bins.shape[1]), np.zeros(len(w))
        for level in range(depth + 1):
            cw, cs, cn = (np.bincount(at, a[cells], wide) for a in (w, s, n))
            mean = cs / np.maximum(cw, 1e-300)
            best, what, where = np.full(wide, 1e-12) * np.maximum(cw, 1e-300), np.full(wide, -1), np.zeros(wide, dtype=np.int64)
            if level < depth:
                may = None if some is None or some >= bins.shape[1] else np.argsort(rng.random((wide, bins.shape[1])), axis=1).argsort(axis=1) < some
                for f, k in enumerate(sizes):
                    if k < 2:
                        continue
                    key = at * k + bins[cells, f]
                    lw, ls, ln = (np.cumsum(np.bincount(key, a[cells], wide * k).reshape(wide, k), axis=1)[:, :-1] for a in (w, s, n))
                    rw, rs, rn = cw[:, None] - lw, cs[:, None] - ls, cn[:, None] - ln
                    # about the node's mean, so that like sides gain nothing by rounding
                    dl, dr = ls - lw * mean[:, None], rs - rw * mean[:, None]
                    good = (ln >= least) & (rn >= least) & (lw > 0) & (rw > 0)
                    gain = np.where(good, dl * dl / np.where(good, lw, 1.0) + dr * dr / np.where(good, rw, 1.0), 0.0)
                    if may is not None:
                        gain[~may[:, f]] = 0.0
                    i = gain.argmax(axis=1)
                    g = gain[np.arange(wide), i]
                    more = g > best
                    best[more], what[more], where[more] = g[more], f, i[more]
            split = what >= 0
            np.add.at(gained, what[split], best[split])
            child = np.where(split, first + wide + 2 * (np.cumsum(split) - 1), 0)
            feature.append(what), cut.append(where), left.append(child), value.append(mean)
            stays = ~split[at]
            out[cells[stays]] = mean[at[stays]]
            cells, at = cells[~stays], at[~stays]
            at = child[at] - first - wide + (bins[cells, what[at]] > where[at])
            first, wide = first + wide, 2 * int(split.sum())
            if not wide:
                break
        return (np.concatenate(feature).astype(np.int16), np.concatenate(cut).astype(np.int16), np.concatenate(left).astype(np.int32), np.concatenate(value)), out, gained

    return grow


_grow = _grower()


def _binned(x, ends):
    return np.column_stack([np.searchsorted(e, c) for e, c in zip(ends, x.T, strict=True)]) if len(ends) else np.zeros((len(x), 0), dtype=int)


def _merged(x, n, ends):
    """Cells that share all bins as one: their bins, rows by class."""
    bins, of = np.unique(_binned(x, ends), axis=0, return_inverse=True)
    both = np.zeros((len(bins), 2))
    np.add.at(both, of.ravel(), n)
    return bins, both


class Model:
    """As a fitted classifier: transform() adds probability. Like rows are scored once."""

    def __init__(self, spark, score, held, gained=None):
        self.score, self.held = score, spark.sparkContext.broadcast(held)
        if gained is not None:
            self.featureImportances = SimpleNamespace(toArray=lambda: gained / gained.sum() if gained.sum() else gained)

    def transform(self, df: DataFrame) -> DataFrame:
        score, held = self.score, self.held

        def scores(batches):
            for b in batches:
                x = np.array(b.column("__a").to_pylist(), dtype="d").reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("__a"), pa.array(score(x, held.value))], ["__a", "__p"])

        rows = df.withColumn("__a", vector_to_array("x"))
        found = rows.select("__a").distinct().mapInArrow(scores, "__a array<double>, __p double")
        return rows.join(found, "__a").withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__a", "__p")


def _walker(link):
    def score(x, held):
        """Sum of the trees' values, each times its weight."""
        ends, trees, weights = held
        bins = np.column_stack([np.searchsorted(e, c) for e, c in zip(ends, x.T, strict=True)])
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for (feature, cut, left, value), weight in zip(trees, weights, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while (on := rows[feature[at] >= 0]).size:
                a = at[on]
                at[on] = left[a] + (bins[on, feature[a]] > cut[a])
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total)) if link else total

    return score


def forest(spark, x: np.ndarray, n: np.ndarray, trees: int, depth: int, least: int, most_bins: int, seed: int) -> Model:
    """Bootstrapped trees over sqrt of the features, classes balanced; tasks grow some trees each."""
    ends = edges(x, n.sum(axis=1), most_bins)
    bins, both = _merged(x, n, ends)
    sizes, weight, some = [len(e) + 1 for e in ends], n.sum() / (2 * n.sum(axis=0)), int(np.ceil(np.sqrt(x.shape[1])))
    grow, given = _grow, spark.sparkContext.broadcast((bins, both))

    def grown(batches):
        bins, both = given.value
        for b in batches:
            for i in b.column("id").to_pylist():
                rng = np.random.default_rng((seed, i))
                drawn = rng.poisson(both)
                w = drawn * weight
                (feature, cut, left, value), _, gained = grow(bins, sizes, w.sum(axis=1), w[:, 1], drawn.sum(axis=1).astype("d"), depth, least, some, rng)
                parts = [feature.tobytes(), cut.tobytes(), left.tobytes(), value.astype("f").tobytes(), (gained / (gained.sum() or 1)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]], ["id", "f", "c", "l", "v", "g"])

    rows = spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(grown, "id long, f binary, c binary, l binary, v binary, g binary").collect()
    made = [(np.frombuffer(r["f"], np.int16), np.frombuffer(r["c"], np.int16), np.frombuffer(r["l"], np.int32), np.frombuffer(r["v"], "f")) for r in sorted(rows, key=lambda r: r["id"])]
    given.unpersist()
    return Model(spark, _walker(False), (ends, made, [1 / trees] * trees), sum(np.frombuffer(r["g"]) for r in rows))


def boosted(spark, x: np.ndarray, n: np.ndarray, rounds: int, depth: int, least: int, most_bins: int, step: float) -> Model:
    """Gradient-boosted trees of the logistic loss, labels -1 and 1, classes balanced: the first tree on labels, each further one on what the loss's gradient leaves."""
    ends = edges(x, n.sum(axis=1), most_bins)
    bins, both = _merged(x, n, ends)
    sizes, w, rows = [len(e) + 1 for e in ends], both * n.sum() / (2 * n.sum(axis=0)), both.sum(axis=1)
    said, made, gained = np.zeros(len(bins)), [], np.zeros(x.shape[1])
    for i in range(rounds):
        y = [-4 / (1 + np.exp(-2 * said)), 4 / (1 + np.exp(2 * said))] if i else [-1.0, 1.0]
        tree, values, g = _grow(bins, sizes, w.sum(axis=1), w[:, 0] * y[0] + w[:, 1] * y[1], rows, depth, least)
        weight = step if i else 1.0
        said += weight * values
        made.append((tree, weight))
        gained += g / (g.sum() or 1) * weight
    return Model(spark, _walker(True), (ends, [t for t, _ in made], [v for _, v in made]), gained)


def _network(layers):
    def forward(x, flat):
        """Outputs of each layer, logistic but for the last, whose are log shares."""
        out, at = [x], 0
        for i, (a, b) in enumerate(zip(layers, layers[1:], strict=False)):
            z = out[-1] @ flat[at : at + a * b].reshape(a, b) + flat[at + a * b : at + a * b + b]
            at += a * b + b
            if i < len(layers) - 2:
                z = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            else:
                z = z - z.max(axis=1, keepdims=True)
                z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            out.append(z)
        return out

    return forward


def network(spark, x: np.ndarray, n: np.ndarray, layers: Sequence[int], steps: int, tolerance: float, seed: int) -> Model:
    """A network of logistic layers by L-BFGS over the mean cross-entropy of all rows."""
    forward, rng, layers = _network(list(layers)), np.random.default_rng(seed), list(layers)
    share, flat = n / n.sum(), np.concatenate([np.r_[(rng.random(a * b) * 4.8 - 2.4) / a, (rng.random(b) * 4.8 - 2.4) / a] for a, b in zip(layers, layers[1:], strict=False)])

    def loss(flat):
        out = forward(x, flat)
        back, grads, at = np.exp(out[-1]) * share.sum(axis=1, keepdims=True) - share, [], len(flat)
        for i in range(len(layers) - 2, -1, -1):
            a, b = layers[i], layers[i + 1]
            at -= a * b + b
            grads.append(np.r_[(out[i].T @ back).ravel(), back.sum(axis=0)])
            if i:
                back = back @ flat[at : at + a * b].reshape(a, b).T * out[i] * (1 - out[i])
        return -(share * out[-1]).sum(), np.concatenate(grads[::-1])

    flat = lbfgs(loss, flat, steps, tolerance)
    return Model(spark, lambda x, flat: np.exp(forward(x, flat)[-1][:, 1]), flat)


def lbfgs(loss, at: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """The least of loss (value and gradient), by steps that hold both conditions of Wolfe; ends when ten steps together gain less than tolerance of the value, or the slope is gone."""
    f, g = loss(at)
    pairs, past = [], [f]
    for _ in range(steps):
        q, used = g.copy(), []
        for s, y, r in reversed(pairs):
            used.append(a := r * (s @ q))
            q -= a * y
        if pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y, r), a in zip(pairs, reversed(used), strict=True):
            q += (a - r * (y @ q)) * s
        if (slope := -(q @ g)) >= 0:
            q, slope, pairs = g, -(g @ g), []
        lo, hi, t = 0.0, np.inf, 1.0 if pairs else min(1.0, 1 / max(np.linalg.norm(g), 1e-300))
        for _ in range(30):
            new = at - t * q
            f2, g2 = loss(new)
            if not f2 <= f + 1e-4 * t * slope:
                hi = t
            elif -(q @ g2) < 0.9 * slope:
                lo = t
            else:
                break
            t = (lo + hi) / 2 if np.isfinite(hi) else 2 * t
        if not f2 < f:
            break
        s, y = new - at, g2 - g
        if (sy := s @ y) > 1e-300:
            pairs = [*pairs, (s, y, 1 / sy)][-memory:]
        at, f, g = new, f2, g2
        past.append(f)
        if np.linalg.norm(g) <= tolerance * 1e-2 or len(past) > 10 and past[-11] - f <= tolerance * max(abs(f), 1e-12):
            break
    return at


def fitted(spark, plan, x: np.ndarray, n: np.ndarray) -> Model:
    """What Spark ML's estimator would learn, with its own settings."""
    if hasattr(plan, "getNumTrees"):
        return forest(spark, x, n, plan.getNumTrees(), plan.getMaxDepth(), plan.getMinInstancesPerNode(), plan.getMaxBins(), plan.getSeed())
    if hasattr(plan, "getLayers"):
        return network(spark, x, n, plan.getLayers(), plan.getMaxIter(), plan.getTol(), plan.getSeed())
    return boosted(spark, x, n, plan.getMaxIter(), plan.getMaxDepth(), plan.getMinInstancesPerNode(), plan.getMaxBins(), plan.getStepSize())
