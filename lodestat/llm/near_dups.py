"""Near duplicates: DartMinHash signatures, banded joining, exact checks, classes.

Darts are thrown into the region (element, weight, rank) as a Poisson process
of unit rate that depends on the element alone: each unit layer of an
element's weight gets dart ranks with exponential gaps, each dart a position
within its layer and one of k coordinates. A text keeps, per coordinate, the
earliest dart under its weights. Only darts up to rank t / (sum of weights)
are made, so a text costs one hash per shingle and about t darts; a text with
an empty coordinate throws on at twice the rank.

Two texts agree in a coordinate with the probability of their weighted
Jaccard similarity. Elements are runs of five lower-cased words; the weight of
one is how often the text has it, or 1 for each with counted=False, for which
similarity is that of plain sets. Texts at 0.8 or more are linked, checked on
their whole weighted sets: signatures only bring texts together, in BANDS bands
of ROWS coordinates, which a pair at exactly 0.8 shares with odds of 0.99995.

Classes are connected components. Buckets (equal band keys) are never
expanded into all pairs: each is first a star around one leader. A bucket
whose members are still in several components is searched in blocks of
bounded size: all pairs from different components whose sizes leave a link
possible are compared, and links that join components come out; two blocks of
one component never meet. So each two texts that share a bucket end in one
class or have been compared. Joins split keys of many rows (hubs of stars,
texts with many copies, buckets of many members).

Defined results: exact copies (equal lower-cased text, null as empty) are one
node. Texts without words are copies only of equal texts. Repeated rows share
a class. class_id is the least doc_id of the class (null if all are null), and
one row of each class is its keeper. An empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import durable, gathered, known_places, split_join

WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
#: Buckets of at most SMALL members are paired by a join, larger ones in blocks of about BLOCK members.
SMALL, BLOCK = 24, 512
#: More rows than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 300_000

_EMPTY = np.uint64(2**64 - 1)


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """owners x k earliest darts (rank in the high half, identity in the low). weights: None for 1 each; owner: ascending.

    An element may come twice with weight 1: equal darts change nothing.
    """
    out = np.full(owners * k, _EMPTY, np.uint64)
    if not len(elements):
        return out.reshape(owners, k)
    if weights is None:
        base, layer, left, of = textvec.mix(elements), None, None, owner
        total = np.bincount(owner, minlength=owners).astype(np.float64)
    else:
        layers = np.ceil(weights).astype(np.int64)
        place = np.repeat(np.arange(len(elements)), layers)
        layer = np.arange(len(place)) - np.repeat(np.cumsum(layers) - layers, layers)
        base = textvec.mix(elements[place] + textvec.mix(layer.astype(np.uint64) + np.uint64(1)) * (layer > 0))
        left, of = weights[place] - layer, owner[place]
        total = np.bincount(owner, weights, minlength=owners)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    rank, number = np.zeros(len(base)), 0
    live = np.arange(len(base))
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    numbers = np.zeros(len(base), np.int64)
    while True:
        while len(live):
            number_of = numbers[live]
            roll = textvec.mix(base[live] + (number_of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
            gap = -np.log(((roll >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            now = rank[live] + gap
            hit = now <= reach[of[live]]
            if not hit.all():
                waiting.append((live[~hit],))
            live, now, roll = live[hit], now[hit], roll[hit]
            rank[live] = now
            numbers[live] += 1
            dart = textvec.mix(roll + np.uint64(0x2545F4914F6CDD1D))
            good = slice(None) if left is None else (dart >> np.uint64(40)).astype(np.float64) * 2.0**-24 <= left[live]
            low = (dart & np.uint64(0xFFFFFFFF))[good]
            cell = of[live][good] * k + (low % np.uint64(k)).astype(np.int64)
            key = (now[good].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
            np.minimum.at(out, cell, key)
        lacking = (out.reshape(owners, k) == _EMPTY).any(axis=1) & (total > 0)
        if not lacking.any():
            return out.reshape(owners, k)
        reach[lacking] *= 2
        live = np.concatenate([w[0] for w in waiting]) if waiting else np.zeros(0, np.int64)
        again = lacking[of[live]]
        waiting = [(live[~again],)]
        live = live[again]


def _weighted(part: pa.Array, width: int, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different elements of each text, how often it has each (or 1), and the number of the text, ascending."""
    hashes, _, firsts = textvec.words(*textvec.raw(part))
    elements, of = textvec.shingles(hashes, firsts, width)
    order = np.lexsort((elements, of))
    elements, of = elements[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(of))) if counted else np.ones(len(at), np.int64)
    return elements[at], many, of[at]


def _signed(bands: int, rows: int, width: int, counted: bool):
    k = bands * rows
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("file", pa.string()), ("row", pa.int64()), ("bands", pa.list_(pa.int64())), ("n", pa.int64())])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.utf8_lower(batch.column("text"))
            for at, part in textvec.pieces(texts):
                elements, many, of = _weighted(part, width, counted)
                sig = dart_signatures(elements, None if (many == 1).all() else many.astype(np.float64), of, len(part), k)
                size = np.bincount(of, many, minlength=len(part)).astype(np.int64)
                keys = np.zeros((len(part), bands), np.uint64)
                for r in range(rows):
                    keys = textvec.mix(keys * np.uint64(31) + sig[:, r::rows])
                flat = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                own = [batch.column(c).slice(at, len(part)) for c in ("doc_id", "key", "file", "row")]
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(own, schema, strict=False)], pa.ListArray.from_arrays(pa.array(flat), pa.array(keys[size > 0].reshape(-1).view(np.int64))), pa.array(size)], schema=schema)

    return signed


def _shingled(width: int, counted: bool):
    """The weighted set of each text as a plain one: an element that it has m times is m different ones, ascending."""
    schema = pa.schema([("key", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.utf8_lower(batch.column("text"))
            for at, part in textvec.pieces(texts):
                elements, many, of = _weighted(part, width, counted)
                place = np.repeat(np.arange(len(elements)), many)
                layer = (np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64)
                own, of = np.where(layer > 0, textvec.mix(elements[place] + textvec.mix(layer)), elements[place]), of[place]
                own = own.view(np.int64)
                own = own[np.lexsort((own, of))]
                flat = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(part)), pa.ListArray.from_arrays(pa.array(flat), pa.array(own))], schema=schema)

    return shingled


def text_key():
    """16 bytes that stand for the lower-cased text."""
    return F.unhex(F.md5(F.lower(F.coalesce("text", F.lit(""))).cast("binary")))


def sparing(small: DataFrame, rows: int) -> DataFrame:
    """small, marked for broadcast only if its counted rows are few."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(key, root) for each end of edges (a, b), at most rows: least key of its component, by minima over neighbours and pointer jumps.

    Each turn is written to the shared folder; turns grow with the logarithm of a component's breadth.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = durable(gathered(both, 2 * rows), "edges")
    rows = both.count()
    roots = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("root"))
    roots = durable(gathered(roots, rows), "roots")
    while True:
        near = split_join(both, rows, roots.select(F.col("key").alias("b"), "root"), ["b"], ["a"]).groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        turned = durable(gathered(roots.join(near, "key").select("key", "root", F.least("root", "near").alias("next")), rows), "turned")
        jump = split_join(turned, rows, turned.select(F.col("key").alias("next"), F.col("next").alias("far")), ["next"], ["key"])
        jump = durable(gathered(jump.select("key", "root", F.least("next", "far").alias("next")), rows), "roots")
        changed = jump.where("root <> next").limit(1).count()
        roots = jump.select("key", F.col("next").alias("root"))
        if not changed:
            return roots


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, counted: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, key, file and row (its place in docs), class_id, keeper (for one row of each class)."""
    lean = known_places(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("__file").alias("file"), F.col("__row").alias("row")).withColumn("key", text_key())
    signed = durable(lean.mapInArrow(_signed(bands, rows, width, counted), "doc_id long, key binary, file string, row long, bands array<long>, n long"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")).alias("first")
    nodes = durable(signed.groupBy("key").agg(first, F.first("bands").alias("bands"), F.first("n").alias("n")), "nodes")
    member = nodes.where("size(bands) > 0").select("key", "n", F.posexplode("bands").alias("band", "bucket"))
    # rank: a fixed random order, the same in every band, so that a text meets few different leaders
    member = durable(member.withColumn("rank", F.struct(F.xxhash64("key").alias("h"), "key", "n")), "member")
    leaders = member.groupBy("band", "bucket").agg(F.min("rank").alias("lead"), F.max("rank").alias("end")).where("lead.key <> end.key").select("band", "bucket", F.col("lead.key").alias("lead"), F.col("lead.n").alias("lead_n"))
    member = durable(split_join(member.drop("rank"), member.count(), leaders, ["band", "bucket"], ["key"]), "shared")
    shared = member.count()
    star = member.where((F.col("key") != F.col("lead")) & _sizes_allow("n", "lead_n", similarity))
    tested = durable(gathered(_pairs(star.select(F.col("key").alias("a"), F.col("lead").alias("b"))), shared), "pairs")

    # one row for each different text that shares a bucket: only these texts are read again, by their places
    wanted = nodes.join(member.select("key").distinct(), "key", "left_semi").select("key", F.col("first.file").alias("f"), F.col("first.row").alias("r"))
    wanted = durable(gathered(wanted, shared), "wanted")
    texts = lean.select("file", "row", "text").join(sparing(wanted, wanted.count()), (F.col("file") == F.col("f")) & (F.col("row") == F.col("r"))).select("key", "text")
    sets = durable(texts.mapInArrow(_shingled(width, counted), "key binary, shingles array<long>"), "sets")

    n_tested = tested.count()
    edges = durable(gathered(_linked(tested, n_tested, sets, similarity), n_tested, 10_000), "links")
    roots = components(edges, n_tested)
    marked = durable(gathered(member.select("band", "bucket", "key", "n").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), shared), "marked")
    mixed = marked.groupBy("band", "bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).where("r0 <> r1").select("band", "bucket", "size")
    there = durable(gathered(split_join(marked, shared, mixed, ["band", "bucket"], ["key"]), shared), "mixed")
    small = there.where(F.col("size") <= SMALL).select("band", "bucket", "key", "root", "n")
    other = small.select("band", "bucket", F.col("key").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("other_n"))
    found = small.join(other, ["band", "bucket"]).where(F.expr("root <> other_root and key < other") & _sizes_allow("n", "other_n", similarity)).select(F.col("key").alias("a"), F.col("other").alias("b"))
    new = durable(gathered(_pairs(found).join(tested, ["a", "b"], "left_anti"), shared), "pairs")
    n_new = new.count()
    edges = edges.unionByName(durable(gathered(_linked(new, n_new, sets, similarity), n_new, 10_000), "links"))
    large = _blocks(there.where(F.col("size") > SMALL), sets, nodes)
    edges = edges.unionByName(durable(large.groupBy("band", "bucket", "i", "j").applyInArrow(_met(similarity), "a binary, b binary"), "links"))
    roots = components(edges, n_tested + n_new)
    rooted = durable(nodes.select("key", "first").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    whose = split_join(rooted.select("key", "root"), rooted.count(), best, ["root"], ["key"]).select("key", F.col("best.doc_id").alias("class_id"), F.col("best.file").alias("f"), F.col("best.row").alias("r"))
    out = split_join(signed.select("doc_id", "key", "file", "row"), signed.count(), durable(whose, "whose"), ["key"], ["file", "row"])
    return out.select("doc_id", "key", "file", "row", "class_id", ((F.col("file") == F.col("f")) & (F.col("row") == F.col("r"))).alias("keeper"))


def _sizes_allow(a: str, b: str, similarity: float):
    """No two sets are more alike than the smaller's share of the larger."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _blocks(there: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of large buckets for each two blocks that may hold a link: a component of more than BLOCK members has blocks of its own, which never meet
    each other; all others share blocks, component by component."""
    here = ["band", "bucket"]
    own = there.groupBy(*here, "root").agg(F.count(F.lit(1)).alias("many"))
    rest = own.where(F.col("many") <= BLOCK).groupBy(*here).agg(F.sum("many").alias("rest"))
    own = own.join(rest, here, "left").select(*here, "root", F.when(F.col("many") > BLOCK, F.ceil(F.col("many") / BLOCK)).alias("parts"), F.ceil(F.col("rest") / BLOCK).alias("shared"))
    own = durable(own, "own")
    blocks = own.where("parts is not null").select(*here, F.col("root").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = blocks.unionByName(own.where("parts is null").select(*here, F.lit(None).cast("binary").alias("of"), F.pmod(F.xxhash64("root"), F.col("shared")).alias("part")).distinct())
    blocks = durable(blocks.select(*here, F.struct(F.coalesce("of", F.lit(b"")).alias("of"), "part").alias("block")), "blocks")
    two = blocks.join(blocks.withColumnRenamed("block", "other"), here).where("block <= other and (block.of <> other.of or block.of = x'')")
    two = two.select(*here, F.explode(F.array_distinct(F.array("block", "other"))).alias("block"), F.col("block").alias("i"), F.col("other").alias("j"))
    place = F.when(F.col("parts").isNull(), F.struct(F.lit(b"").alias("of"), F.pmod(F.xxhash64("root"), F.col("shared")).alias("part"))).otherwise(F.struct(F.col("root").alias("of"), F.pmod(F.xxhash64("key"), F.col("parts")).alias("part")))
    rows = there.join(own, [*here, "root"]).withColumn("block", place).drop("parts", "shared", "size", "n")
    rows = rows.join(two, [*here, "block"])
    return rows.join(nodes.select("key", "bands"), "key").join(sets, "key").select(*here, "i", "j", "block", "key", "root", "bands", "shingles")


def _met(similarity: float):
    """Of two blocks of a bucket: links that join its components, from whole sets. A pair whose ends have come together needs no check,
    and one that shares an earlier band's bucket is left to that."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def met(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        sizes = pc.list_value_length(rows.column("shingles")).to_numpy()
        rows = rows.take(np.argsort(sizes, kind="stable"))
        keys = rows.column("key").to_pylist()
        group = np.unique([r.hex() for r in rows.column("root").to_pylist()], return_inverse=True)[1]
        apart = rows.column("i")[0] != rows.column("j")[0]
        block = np.unique([str(r.as_py()) for r in rows.column("block")], return_inverse=True)[1]
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)[:, : rows.column("band")[0].as_py()]
        column = rows.column("shingles").combine_chunks()
        flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.sort(sizes))])
        ids = np.unique(flat, return_inverse=True)[1]
        mark, out = np.zeros(len(flat) + 1, bool), []
        for x in range(n):
            size = ends[x + 1] - ends[x]
            upto = int(np.searchsorted(np.diff(ends), size / similarity + 1e-9, side="right"))
            y = np.arange(x + 1, upto)
            y = y[group[y] != group[x]]
            if apart:
                y = y[block[y] != block[x]]
            y = y[~(bands[y] == bands[x]).any(axis=1)]
            if not len(y):
                continue
            mark[ids[ends[x] : ends[x + 1]]] = True
            for z in y.tolist():
                if group[z] != group[x]:
                    common = int(mark[ids[ends[z] : ends[z + 1]]].sum())
                    if common >= similarity * (size + ends[z + 1] - ends[z] - common):
                        out.append((x, z))
                        group[group == group[z]] = group[x]
            mark[ids[ends[x] : ends[x + 1]]] = False
        return pa.Table.from_arrays([pa.array([keys[x] for x, _ in out], pa.binary()), pa.array([keys[y] for _, y in out], pa.binary())], schema=schema)

    return met


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(pairs: DataFrame, rows: int, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs, so many, whose whole sets are as similar as asked."""
    left = split_join(pairs, rows, sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), ["a"], ["b"])
    # of a hub's pairs at b the far ends salt; those were counted in pairs, which the sets are joined to
    whole = split_join(pairs, rows, sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), ["b"], ["a"]).join(left, ["a", "b"])
    common = whole.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return common.where(F.col("n") >= similarity * (F.col("m") - F.col("n"))).select("a", "b")


def deduplicated(docs: DataFrame, **given) -> DataFrame:
    """docs with one row of each class, all its columns."""
    names = docs.columns
    known = known_places(docs)
    known = known.select(F.struct(*[known[c] for c in names]).alias("__doc"), F.col("__file").alias("__f"), F.col("__row").alias("__r"), known["doc_id"], known["text"], "__file", "__row")
    found = classes(known.select("doc_id", "text", "__file", "__row"), **given)
    gone = durable(found.where("not keeper").select(F.col("file").alias("__f"), F.col("row").alias("__r")), "gone")
    return known.select("__doc", "__f", "__r").join(sparing(gone, gone.count()), ["__f", "__r"], "left_anti").select("__doc.*")
