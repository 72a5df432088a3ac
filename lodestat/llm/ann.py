"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

Equal vectors are one point (with its k + 1 least ids), so copies can't fill
a graph's neighbour lists. Points are dealt into shards of bounded size by a
hash. A shard's graph is hierarchical: each level is one flat array of
neighbour places, -1 where there is none. Points enter in blocks; a block
searches the graph of the points before it all at once, beside its own pairwise
distances, keeps diverse neighbours (a candidate closer to a kept neighbour
than to the point is passed over) and links back. Queries, in blocks, search
every shard: a task reads a shard's graph once and then one block of queries
after another, so it holds one graph and one block, whatever the table. The
best of all shards are merged.

Distances are differences in double precision throughout, of vectors divided by
one power of two, which is exact: no shift or size of finite components loses
digits, overflows or vanishes (unless components of one table differ by 1e150).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null ids; repeated rows count once; of an id
with several vectors the least, component by component, counts; vectors meet
only those of their own length. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Points of a shard; neighbours of a point (twice as many on the ground level); beams while building and searching.
SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM, QUERY_BLOCK = 8_192, 16, 80, 128, 256


class Graph:
    """vectors: points x dimensions; levels[l]: points x degree places."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        n = len(vectors)
        top = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / math.log(degree)).astype(np.int64)
        self.levels = [np.full((n, degree * (1 if level else 2)), -1, np.int32) for level in range(int(top.max(initial=0)) + 1)]
        self.entry, self.height = 0, -1
        at, size = 0, 64
        while at < n:
            self._enter(np.arange(at, min(n, at + size)), top, beam)
            at, size = at + size, min(512, 2 * size)

    def _far(self, queries: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Squared distances of each query to the points in its row of places; infinite at -1."""
        gap = self.vectors[places]
        gap -= queries[:, None, :]
        d = np.einsum("ijd,ijd->ij", gap, gap)
        d[places < 0] = np.inf
        return d

    def search(self, queries: np.ndarray, entries: np.ndarray, level: int, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest points found for each query: places and squared distances, nearest first."""
        links, b = self.levels[level], len(queries)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, len(self.vectors) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        places = np.full((b, beam), -1, np.int64)
        places[:, 0] = entries
        far = self._far(queries, places)
        seen[rows[:, 0], entries] = True
        done = places < 0
        while True:
            waiting = np.where(done, np.inf, far)
            nearest = np.argpartition(waiting, min(wide, beam - 1), axis=1)[:, :wide]
            open_ = np.isfinite(np.take_along_axis(waiting, nearest, 1))
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                return places, far
            np.put_along_axis(done, nearest, True, 1)
            at = np.where(open_[live], np.take_along_axis(places, nearest, 1)[live], -1)
            new = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1).astype(np.int64)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[live[:, None], new]] = -1
            seen[live[:, None], new] = True
            both = np.concatenate([places[live], new], axis=1)
            dist = np.concatenate([far[live], self._far(queries[live], new)], axis=1)
            flags = np.concatenate([done[live], new < 0], axis=1)
            order = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            part = np.take_along_axis(dist, order, 1)
            order = np.take_along_axis(order, np.argsort(part, axis=1, kind="stable"), 1)
            places[live] = np.take_along_axis(both, order, 1)
            far[live] = np.take_along_axis(dist, order, 1)
            done[live] = np.take_along_axis(flags, order, 1) | ~np.isfinite(far[live])
            places[live] = np.where(np.isfinite(far[live]), places[live], -1)

    def descend(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full(len(queries), self.entry)
        for level in range(self.height, 0, -1):
            entries = self.search(queries, entries, level, 8)[0][:, 0]
        return self.search(queries, entries, 0, beam)

    def _diverse(self, points: np.ndarray, places: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Up to most of each row's candidates (nearest first, -1 last), none closer to a kept one than to the point; gaps go to the nearest left."""
        b, c = places.shape
        x = self.vectors[places] - points[:, None, :]  # seen from the point, so that the products below keep their digits
        norms = np.einsum("ijd,ijd->ij", x, x)
        apart = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        kept = np.zeros((b, c), bool)
        for j in range(c):
            close = np.where(kept[:, :j], apart[:, j, :j], np.inf).min(axis=1, initial=np.inf)
            kept[:, j] = (places[:, j] >= 0) & (far[:, j] < close) & (kept[:, :j].sum(axis=1) < most)
        rank = np.where(places < 0, 2 * c, np.where(kept, 0, c)) + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(places, order, 1)
        return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)

    def _enter(self, block: np.ndarray, top: np.ndarray, beam: int) -> None:
        q, b = self.vectors[block], len(block)
        within = np.concatenate([self._far(q[i : i + 32], np.broadcast_to(block, (len(q[i : i + 32]), b))) for i in range(0, b, 32)])
        np.fill_diagonal(within, np.inf)
        height = self.height
        entries = np.full(b, self.entry)
        for level in range(len(self.levels) - 1, -1, -1):
            places, far = np.full((b, 0), -1, np.int64), np.zeros((b, 0))
            if level <= height:
                places, far = self.search(q, entries, level, beam if level == 0 else 32)
                entries = places[:, 0]
            mine = np.flatnonzero(top[block] >= level)
            if not len(mine):
                continue
            own = np.where(top[block][None, :] >= level, within[mine], np.inf)
            near = np.argsort(own, axis=1, kind="stable")[:, :beam]
            mates = np.take_along_axis(own, near, 1)
            places = np.concatenate([places[mine], np.where(np.isfinite(mates), block[near], -1)], axis=1)
            far = np.concatenate([far[mine], mates], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            places, far = np.take_along_axis(places, order, 1), np.take_along_axis(far, order, 1)
            links = self.levels[level]
            most = links.shape[1]
            chosen = self._diverse(q[mine], places, far, most // 2 if level == 0 else most)
            links[block[mine], : chosen.shape[1]] = chosen
            self._link_back(links, np.repeat(block[mine], chosen.shape[1]), chosen.reshape(-1))
        tallest = int(block[np.argmax(top[block])])
        if top[tallest] > height:
            self.entry, self.height = tallest, int(top[tallest])

    def _link_back(self, links: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
        ok = targets >= 0
        sources, targets = sources[ok], targets[ok]
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        nodes, first, many = np.unique(targets, return_index=True, return_counts=True)
        most = links.shape[1]
        for part in np.array_split(np.arange(len(nodes)), max(1, len(nodes) // 512)):
            wide = int(many[part].max(initial=0))
            new = np.full((len(part), wide), -1, np.int64)
            for k in range(wide):
                has = many[part] > k
                new[has, k] = sources[first[part][has] + k]
            every = np.concatenate([links[nodes[part]].astype(np.int64), new], axis=1)
            every.sort(axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            far = self._far(self.vectors[nodes[part]], every)
            order = np.argsort(far, axis=1, kind="stable")
            every, far = np.take_along_axis(every, order, 1), np.take_along_axis(far, order, 1)
            full = (every >= 0).sum(axis=1) > most
            out = every[:, :most]
            if full.any():
                out[full] = self._diverse(self.vectors[nodes[part][full]], every[full][:, : 3 * most], far[full][:, : 3 * most], most)
            links[nodes[part], : out.shape[1]] = out

    def packed(self) -> dict:
        return {"entry": self.entry, "height": self.height, "levels": [x.tobytes() for x in self.levels]}

    @classmethod
    def of(cls, vectors: np.ndarray, entry: int, height: int, levels: list[bytes]) -> Graph:
        self = cls.__new__(cls)
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        self.entry, self.height = entry, height
        self.levels = [np.frombuffer(x, np.int32).reshape(len(vectors), -1) for x in levels]
        return self


_INDEX = pa.schema([("shard", pa.int64()), ("dims", pa.int32()), ("points", pa.list_(pa.int64())), ("vectors", pa.binary()), ("entry", pa.int64()), ("height", pa.int32()), ("levels", pa.list_(pa.binary()))])


def _indexed(rows: pa.Table) -> pa.Table:
    """One shard's graph as one row; the shard's size is bounded, whatever the table's."""
    rows = rows.sort_by("point")
    dims = rows.column("dims")[0].as_py()
    vectors = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
    g = Graph(vectors, seed=len(vectors)).packed()
    return pa.Table.from_pylist([{"shard": rows.column("shard")[0].as_py(), "dims": dims, "points": rows.column("point").to_pylist(), "vectors": vectors.astype("<f8").tobytes(), "entry": g["entry"], "height": g["height"], "levels": g["levels"]}], schema=_INDEX)


def _searcher(k: int, beam: int):
    """For rows by shard, its index first and blocks of queries after it: the k nearest points of the shard for each query."""
    schema = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("far", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, points = None, np.zeros(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                dims = row["dims"].as_py()
                if not row["asks"].as_py():
                    points = row["points"].values.to_numpy()
                    vectors = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(len(points), dims)
                    graph = Graph.of(vectors, row["entry"].as_py(), row["height"].as_py(), row["levels"].as_py())
                    continue
                names = row["points"].values.to_numpy()
                queries = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(len(names), dims)
                places, far = graph.descend(queries, min(max(beam, k), max(2, len(points))))
                # a query that found fewer than there are, as no link led on, goes over the whole shard
                for j in np.flatnonzero((places >= 0).sum(axis=1) < min(k, len(points))):
                    every = graph._far(queries[j : j + 1], np.arange(len(points))[None, :])[0]
                    near = np.argsort(every, kind="stable")[: places.shape[1]]
                    places[j, : len(near)], far[j, : len(near)] = near, every[near]
                far[places < 0] = np.inf
                far = np.sqrt(far)
                order = np.lexsort((points[places], far), axis=1)[:, :k]
                far, ids = np.take_along_axis(far, order, 1), points[np.take_along_axis(places, order, 1)]
                ok = np.isfinite(far)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ok.sum(axis=1))), pa.array(ids[ok]), pa.array(far[ok])], schema=schema)

    return search


def _block(rows: pa.Table) -> pa.Table:
    """One block of queries, as one row."""
    rows = rows.sort_by("query")
    vectors = rows.column("v").combine_chunks().flatten().to_numpy()
    return pa.Table.from_pylist([{"dims": rows.column("dims")[0].as_py(), "block": rows.column("block")[0].as_py(), "points": rows.column("query").to_pylist(), "vectors": vectors.astype("<f8").tobytes()}], schema=pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("points", pa.list_(pa.int64())), ("vectors", pa.binary())]))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found; queries are the rows with an id divisible by every."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = rows.where(usable).selectExpr("vec_id", "transform(v, x -> x + 0.0D) AS v")
    rows = durable(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    largest = rows.agg(F.max(F.expr("array_max(transform(v, x -> abs(x)))")).alias("x")).first()["x"]
    unit = 2.0 ** (math.frexp(largest)[1] - 1) if largest else 1.0
    # the limit on the rank is applied before the shuffle too, so a vector that many rows share costs each task k + 1 rows
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    points = durable(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("point"), "v", "ids", F.size("v").alias("dims")), "points")
    scaled = F.transform("v", lambda x: x / F.lit(unit))
    shards = points.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / shard).cast("long").alias("shards"))
    dealt = points.join(shards, "dims").withColumn("shard", F.pmod(F.xxhash64("point", F.lit(5)), F.col("shards")) + F.col("dims").cast("long") * F.lit(1 << 32))
    index = dealt.select("shard", "dims", "point", scaled.alias("v")).groupBy("shard").applyInArrow(_indexed, "shard long, dims int, points array<long>, vectors binary, entry long, height int, levels array<binary>")
    index = durable(index, "index", 8)

    asked = rows.where(F.col("vec_id") % every == 0)
    whose = durable(asked.join(points.select("v", "point"), "v").select("vec_id", F.col("point").alias("query"), "v"), "asked")
    blocks = whose.groupBy("query").agg(F.first(scaled).alias("v")).withColumn("dims", F.size("v"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, math.ceil(whose.count() / QUERY_BLOCK)))))
    blocks = durable(blocks.groupBy("dims", "block").applyInArrow(_block, "dims int, block long, points array<long>, vectors binary"), "blocks", 64)
    # the stated queries, in blocks, go to every shard of their length; each shard's index goes once, ahead of them
    met = blocks.join(index.select("shard", "dims"), "dims").select("shard", "dims", F.lit(True).alias("asks"), "block", "points", "vectors", F.lit(None).cast("long").alias("entry"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("array<binary>").alias("levels"))
    both = index.select("shard", "dims", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("block"), "points", "vectors", "entry", "height", "levels").unionByName(met)
    both = both.repartition("shard").sortWithinPartitions("shard", "asks", "block")
    found = durable(both.mapInArrow(_searcher(k + 1, beam), "query long, point long, far double"), "found", 8)

    best = Window.partitionBy("query").orderBy("far", "point")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ids = found.join(points.select("point", "ids"), "point").select("query", "far", F.explode("ids").alias("id"))
    least = ids.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("near"))
    out = whose.select("vec_id", "query").join(least, "query")
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (F.col("x.far") * F.lit(unit)).alias("score"))
