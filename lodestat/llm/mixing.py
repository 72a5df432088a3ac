"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed random order, are cut into blocks of
block_bytes of text. With weight w, block j of a source is released at slot
floor(j / w) and due at slot ceil((j + 1) / w); earliest-deadline-first fills
one slot after another. On one "processor" with weights that sum to 1 this
meets every deadline, so after any number of slots t a source has had more
than w * t - 1 and less than w * t + 1 blocks. Weights are fractions without
rounding, so this holds over any number of slots.

The schedule is worked out block by block on the driver, from the number of
blocks of each source alone. So that it doesn't grow with the corpus, blocks
do: block_bytes is the least power of two, from BLOCK_BYTES, that makes at
most SLOTS blocks (16 KB up to 16 GB of text, 128 MB for 100 TB). A source that
runs out leaves its slots empty and the others go on in their windows: every
document has one place and none is dropped or repeated. on_target marks the
slots before the first source ran out.

Defined results: null text has no bytes and shares the place of its
neighbours; a null source is a source. A document longer than a block takes
up the slots that its bytes fill and stands at the first. Each of repeated rows
has a place of its own. Weights that are negative, null or no numbers count as
0. Sources with weight 0, or without one, have no slot in the schedule: their
blocks follow after its last slot, source by source. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, known_places, ranked
from .near_dups import sparing, text_key

#: Bytes of text in a block, at least; blocks of a schedule, at most (and one more for each source); power of a source's size that gives its default weight.
BLOCK_BYTES, SLOTS, TEMPERATURE = 16_384, 1 << 20, 0.5
#: Slots of a source that travel as one row.
_CHUNK = 4_096


def _name(s: str | None) -> tuple[bool, str]:
    return s is None, s or ""


def shares(weights: dict[str | None, float | None]) -> dict[str | None, Fraction]:
    """Exact parts of 1; 0 for weights that are no positive numbers."""
    exact = {s: Fraction(w) if w is not None and math.isfinite(w) and w > 0 else Fraction(0) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w / total if total else w for s, w in exact.items()}


def slots(weights: dict[str | None, Fraction], blocks: dict[str | None, int]) -> dict[str | None, list[int]]:
    """The slot of each block of each source: earliest deadline first among released blocks, from slot 0."""
    names = sorted(blocks, key=_name)
    out: dict[str | None, list[int]] = {s: [] for s in names}
    terms = [(weights[s].numerator, weights[s].denominator) for s in names]
    coming = [(0, i) for i, s in enumerate(names) if blocks[s] and weights[s]]
    left, t = sum(blocks[names[i]] for _, i in coming), 0
    due: list[tuple[int, int]] = []
    while left:
        if not due:
            t = max(t, coming[0][0])
        while coming and coming[0][0] <= t:
            _, i = heapq.heappop(coming)
            p, q = terms[i]
            heapq.heappush(due, (-(-(len(out[names[i]]) + 1) * q // p), i))
        deadline, i = heapq.heappop(due)
        assert t < deadline, "every block meets its deadline"
        own, (p, q) = out[names[i]], terms[i]
        own.append(t)
        if len(own) < blocks[names[i]]:
            heapq.heappush(coming, (max(t + 1, len(own) * q // p), i))
        t += 1
        left -= 1
    for s in names:
        if not weights[s]:
            out[s] = list(range(t, t + blocks[s]))
            t += blocks[s]
    return out


def scheduled(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, temperature: float = TEMPERATURE, most: int = SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, key, bytes, block, slot, place (order within the slot), on_target, and the columns of docs named by keep."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    lean = durable(docs.select("doc_id", F.col("source").cast("string").alias("source"), text_key().alias("key"), size.alias("bytes"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]), "lean")
    lean = known_places(lean)
    sizes = {r["source"]: r["b"] for r in lean.groupBy("source").agg(F.sum("bytes").alias("b")).collect()}
    while sum(sizes.values()) > block_bytes * most:
        block_bytes *= 2
    kept = [F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)]
    if not sizes:
        return lean.select("doc_id", "source", "key", "bytes", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("on_target"), *kept)
    if weights is None:
        weights = {s: float(max(b, 1)) ** temperature for s, b in sizes.items()}
    exact = shares({s: weights.get(s) for s in sizes})
    # a document without bytes after the last whole block begins one more
    blocks = {s: b // block_bytes + 1 for s, b in sizes.items()}
    own_slots = slots(exact, blocks)
    runs_out = min((-(-b // block_bytes) * exact[s].denominator // exact[s].numerator for s, b in sizes.items() if exact[s]), default=0)
    rows = ", ".join(f"({'NULL' if s is None else _literal(s)}, {i}L, '{','.join(map(str, own[i * _CHUNK : (i + 1) * _CHUNK]))}')" for s, own in own_slots.items() for i in range(-(-len(own) // _CHUNK)))
    table = docs.sparkSession.sql(f"SELECT cast(s AS string) AS __s, c AS __c, transform(split(a, ','), x -> cast(x AS long)) AS __a FROM VALUES {rows} AS t(s, c, a)")
    # repeated rows have one hash: their places in the files spread them; the order of all others depends on the data alone
    repeated = durable(lean.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key2")), "repeated")
    alike = repeated.count()
    if alike:
        lean = lean.join(sparing(repeated, alike), lean["doc_id"].eqNullSafe(F.col("__id")) & (lean["key"] == F.col("__key2")), "left")
        lean = lean.withColumn("__copy", F.when(F.col("__key2").isNotNull(), F.xxhash64("__file", "__row"))).drop("__id", "__key2")
    else:
        lean = lean.withColumn("__copy", F.lit(None).cast("long"))
    own = ranked(lean, ["source"], ["__h", "doc_id", "key", "__file", "__row"], ["doc_id", "key", "__copy"], "bytes", few_keys=True, add={"__h": F.xxhash64("doc_id", "key")})
    own = own.withColumn("block", F.floor(F.col("__before") / block_bytes).cast("long"))
    # most blocks and one for each source: bounded
    own = own.join(F.broadcast(table), own["source"].eqNullSafe(F.col("__s")) & (F.expr(f"block DIV {_CHUNK}") == F.col("__c")))
    out = own.withColumn("slot", F.element_at("__a", (F.col("block") % _CHUNK + 1).cast("int")))
    return out.select("doc_id", "source", "key", "bytes", "block", "slot", F.col("__rank").alias("place"), (F.col("slot") < runs_out).alias("on_target"), *kept)


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mixed(docs: DataFrame, **given) -> DataFrame:
    """docs, all rows and columns, laid out in schedule order: partition by partition, row by row."""
    names = docs.columns
    known = known_places(docs)
    known = known.select(F.struct(*[known[c] for c in names]).alias("__doc"), "__file", "__row", *[known[c] for c in ("doc_id", "text", "source")])
    plan = scheduled(known, keep=("__file", "__row"), **given).select(F.col("__file").alias("__f"), F.col("__row").alias("__r"), F.struct("slot", "place").alias("__at"))
    plan = durable(plan, "plan")
    placed = known.select("__doc", "__file", "__row").join(sparing(plan, plan.count()), (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r"))).select("__doc", "__at")
    return placed.repartitionByRange("__at").sortWithinPartitions("__at").select("__doc.*")
