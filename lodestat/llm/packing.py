"""Best-fit packing of token pieces into sequences, by a configuration linear program over the length histogram.

A configuration says how many pieces of each length share one sequence. The
program (fewest sequences that cover the histogram) is taken on by
multiplicative weights: lengths that are covered least get the highest
prices, a knapsack by dynamic programming, bounded by the pieces there are,
prices out the best configuration around each length, and these get steps.
One pass ends at a gap of GAP or, in practice, at its number of rounds, which
grows with the root of the number of lengths; its cover of the last lengths
is loose then. Whole sequences are taken, the program is solved again for the
rest, and what is left, at most LEFT pieces a length, goes best-fit
decreasing. packed() prints the share that the program placed. The driver
sees only the histogram (at most capacity rows). A piece finds its place by
its rank among the pieces of its length.

Defined results: a null or empty text is the end token alone. Repeated rows
are packed each. An empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import durable, ranked

CAPACITY, END = 2048, 0
#: Different words whose ids a worker keeps; beyond it, it starts anew.
REMEMBERED = 450_000
#: The program is solved until its cover is within this share of its bound; best fit gets at most so many pieces a length.
GAP, LEFT = 0.02, 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, at long"
#: Windows of a schedule that are packed one after the other, at most; sequences that one has at least; rows of a file that stay together.
WINDOWS, WINDOW_SEQUENCES, TOGETHER = 8, 64, 1 << 8
#: Bits of a place that number the row in its file.
ROW_BITS = 40


#: The tokenizer's own split of a text, and the words for which Python's lower case and classes are known to agree with it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters as the letters that byte-level vocabularies write their UTF-8 bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class _Ids(dict):
    """Ids of a word, as little-endian bytes, worked out when first asked for.

    The tokenizer drops white space and never joins across it, so words are
    encoded apart from their texts. A plain word goes through the tokenizer's
    model directly, run by run; any other through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.runs = self.tokenizer.model, _byte_letters(), {}
        self.split = regex.compile(_SPLIT).findall

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            ids = array("I", [x.id for x in self.model.tokenize(run if run.isascii() else run.translate(self.letters))]).tobytes()
            if len(run) <= 64:
                if len(self.runs) >= REMEMBERED:
                    self.runs.clear()
                self.runs[run] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.islower() and word.isalpha():
            ids = array("I", [x.id for x in self.model.tokenize(word)]).tobytes()
        elif _PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self._run, self.split(word.lower())))
        else:
            ids = self.encode(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


#: Latin-1 bytes as a letter or digit, a space, one of "., " that often follow a word, or anything else.
_MARKS = bytes(ord(" " if chr(c).isspace() else "a" if chr(c).isalnum() else "." if chr(c) in ".," else "#") for c in range(256))


def parted(text: str) -> list[str]:
    """The words of text, or, where that gives the same ids, its words in lower case with points and commas apart: far fewer different ones.

    A point goes apart if a letter, digit or space is before it and white
    space behind it, in texts of Latin-1, where lower case is the tokenizer's.
    """
    try:
        marks = text.encode("latin-1").translate(_MARKS)
    except UnicodeEncodeError:
        return text.split()
    if b"#. " in marks or b".. " in marks or "<|" in text:
        return text.split()
    return text.lower().replace(". ", " . ").replace(".\n", " .\n").replace(", ", " , ").replace(",\n", " ,\n").split()


#: Python's split() takes these for white space, the tokenizer doesn't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"

_workers_own: dict[str, _Ids] = {}


def ids_of(path: str) -> _Ids:
    """This Python worker's table; a worker that is used for several tasks keeps it."""
    if path not in _workers_own:
        _workers_own[path] = _Ids(path)
    return _workers_own[path]


def laid_out(docs: DataFrame) -> DataFrame:
    """doc_id, text and at, the place of a row in the order in which docs, a table in files, was written: number of the file's task, row."""
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    task = F.coalesce(F.regexp_extract(file, r"^part-([0-9]+)", 1).try_cast("long"), F.lit(0))
    return docs.select("doc_id", "text", (task * (1 << ROW_BITS) + row).alias("at"))


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, ordered: bool = False) -> DataFrame:
    """One row per piece of at most capacity tokens of each whole text and its end token; at is the document's place, 0 unless ordered."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("at", pa.int64())])
    tail, step = np.asarray([end], dtype="<u4").tobytes(), 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        for batch in batches:
            for at, part in textvec.pieces(batch.column("text")):
                rows = []
                for name, place, text in zip(batch.column("doc_id").slice(at, len(part)).to_pylist(), batch.column("at").slice(at, len(part)).to_pylist(), part.to_pylist(), strict=True):
                    text = text or ""
                    odd = any(map(text.__contains__, _NOT_SPACE))
                    whole = (ids.encode(text) if odd else b"".join(map(ids.__getitem__, parted(text)))) + tail
                    for n, start in enumerate(range(0, len(whole), step)):
                        one = whole[start : start + step]
                        rows.append((name, n, start // 4, len(one) // 4, zlib.crc32(one), place))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = laid_out(docs) if ordered else docs.select("doc_id", "text", F.lit(0).cast("long").alias("at"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "at").mapInArrow(pieces, PIECES)


def _priced(prices: np.ndarray, lengths: np.ndarray, supply: np.ndarray, capacity: int, wanted: np.ndarray, order: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Bounded knapsack: (highest price of one sequence, for each wanted length the pieces of the best sequence that holds one, their prices).

    No sequence holds more pieces of a length than there are. Pieces are repeated indices of lengths, in order.
    Of equal prices, lengths that come first in order are taken.
    """
    items, most = [], np.minimum(supply, capacity // lengths)
    for i in order.tolist():
        size, n, many = int(lengths[i]), int(most[i]), 1
        while n > 0:  # 1, 2, 4, ... and the rest make any number up to n
            many = min(many, n)
            items.append((i, many, size * many))
            n -= many
            many *= 2
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for t, (i, many, size) in enumerate(items):
        gains = best[: capacity + 1 - size] + prices[i] * many
        np.greater(gains, best[size:], out=took[t, size:])
        np.maximum(best[size:], gains, out=best[size:])
    room = capacity - lengths[wanted]
    rows, parts, times = [np.arange(len(wanted))], [wanted], [np.ones(len(wanted), np.int64)]
    for t in range(len(items) - 1, -1, -1):
        hit = np.flatnonzero(took[t, room])
        if len(hit):
            i, many, size = items[t]
            room[hit] -= size
            rows.append(hit)
            parts.append(np.full(len(hit), i))
            times.append(np.full(len(hit), many))
    row, part, time = np.concatenate(rows), np.concatenate(parts), np.concatenate(times)
    row, part = np.repeat(row, time), np.repeat(part, time)
    at = np.lexsort((part, row))
    row, part = row[at], part[at]
    found = np.split(part, np.searchsorted(row, np.arange(1, len(wanted))))
    # the wanted piece comes on top of what fits beside it: one too many of a scarce length goes
    found = [own if (own == w).sum() <= supply[w] else np.delete(own, np.searchsorted(own, w)) for own, w in zip(found, wanted.tolist(), strict=True)]
    return float(best[capacity]), found, np.array([prices[own].sum() for own in found])


def _fractional(lengths: np.ndarray, supply: np.ndarray, capacity: int, gap: float = GAP, eps: float = 0.1) -> tuple[list[tuple[np.ndarray, float]], float, float]:
    """Multiplicative weights for the covering program: (pieces of a sequence, how many such), sequences in all, lower bound of the program.

    A round prices out, for each length that is covered less than most, the
    best sequence that holds it, and gives the nearly best of them steps, up to
    eps of each length. Prices begin at the lengths themselves. It ends when
    the cover, scaled to hold every piece, is within gap of the bound that
    prices prove, or after its rounds.
    """
    covered, uses = np.zeros(len(lengths)), Counter()
    bound, at_bound = 0.0, lengths.astype(float)
    rng = np.random.default_rng(len(lengths))
    rounds = 40 + math.isqrt(len(lengths))
    for _ in range(rounds):
        part = covered / supply
        need = np.exp(-(part - part.min()) / eps)
        prices = need * lengths
        wanted = np.flatnonzero(need >= 0.05)
        wanted = wanted[np.argsort(-need[wanted], kind="stable")]
        # plentiful lengths fill up first, in changing order, so that sequences differ
        order = np.argsort(-supply * rng.random(len(supply)), kind="stable")
        top, found, worth = _priced(prices, lengths, supply, capacity, wanted, order)
        if (proven := float(prices @ supply) / top) > bound:
            bound, at_bound = proven, prices / top
        spare = eps * supply
        for k in np.flatnonzero(worth >= min((1 - eps) * top, worth.max())).tolist():
            kinds, times = np.unique(found[k], return_counts=True)
            x = float((spare[kinds] / times).min())
            if x > 0:
                spare[kinds] -= x * times
                uses[found[k].tobytes()] += x
        covered += eps * supply - spare
        least = float((covered / supply).min())
        if least > 0 and sum(uses.values()) / least <= (1 + gap) * bound:
            break
    least = float((covered / supply).min())
    scale = least if least > 0 else float((covered / supply).max())
    ways = [(np.frombuffer(k, np.int64), x / scale) for k, x in uses.items()]
    # the best by the prices of the bound first: what their surplus takes away, worse ones lose
    ways.sort(key=lambda w: (-round(float(at_bound[w[0]].sum()), 3), -w[1], w[0].tobytes()))
    return ways, sum(x for _, x in ways), bound


def _best_fit_decreasing(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    contents: list[Counter] = []
    open_rooms = np.zeros(capacity + 1, np.int64)
    for i in range(len(lengths) - 1, -1, -1):
        size = int(lengths[i])
        for _ in range(int(left[i])):
            fits = np.flatnonzero(open_rooms[size:])
            if len(fits):
                r = size + int(fits[0])
                b = room[r].pop()
                open_rooms[r] -= 1
            else:
                r, b = capacity, len(contents)
                contents.append(Counter())
            contents[b][i] += 1
            room[r - size].append(b)
            open_rooms[r - size] += 1
    same = Counter(tuple(sorted(c.items())) for c in contents)
    out = []
    for items, n in sorted(same.items()):
        one = np.zeros(len(lengths), np.int64)
        for i, m in items:
            one[i] = m
        out.append((one, n))
    return out


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, passes: int = 12) -> list[tuple[dict[int, int], int]]:
    """(length -> pieces in one sequence, number of such sequences), which use every piece exactly once."""
    return programmed(histogram, capacity, passes)[0]


def programmed(histogram: dict[int, int], capacity: int = CAPACITY, passes: int = 12) -> tuple[list[tuple[dict[int, int], int]], dict]:
    """configurations(), and how they came about: share of the pieces under capacity placed by the program, its sequences over its bound.

    histogram: length (1 to capacity) -> pieces. The work depends on the
    number of different lengths only. Each pass solves the program for what is
    left and takes whole sequences of it: numbers are rounded along the list
    so that their running sum is kept, then cut to the pieces that are left.
    """
    full = histogram.get(capacity, 0)
    lengths = np.asarray(sorted(x for x, n in histogram.items() if n > 0 and x < capacity), np.int64)
    left = np.asarray([histogram[int(x)] for x in lengths], np.int64)
    out: list[tuple[np.ndarray, int]] = []
    said: dict = {"pieces": int(left.sum()), "lengths": len(lengths), "passes": []}
    for _ in range(passes):
        live = np.flatnonzero(left > 0)
        if left.sum() <= LEFT * len(lengths) or not len(live):
            break
        ways, many, bound = _fractional(lengths[live], left[live], capacity)
        took, owed = 0, 0.0
        for own, x in ways:
            kinds, times = np.unique(live[own], return_counts=True)
            owed += x
            n = min(int(owed), int((left[kinds] // times).min()))
            owed -= int(owed)
            if n > 0:
                one = np.zeros(len(lengths), np.int64)
                one[kinds] = times
                out.append((one, n))
                left[kinds] -= n * times
                took += n
        said["passes"].append((round(many / bound - 1, 4), took))
        if not took:
            break
    said["left"] = int(left.sum())
    said["placed"] = 1 - said["left"] / said["pieces"] if said["pieces"] else 1.0
    out += _fill(lengths, left, capacity)
    found = [({int(lengths[i]): int(one[i]) for i in np.flatnonzero(one)}, n) for one, n in out]
    return ([({capacity: 1}, full)] if full else []) + found, said


def _fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Take many alike at a time while supplies are large, then best-fit decreasing one by one."""
    out, left = [], left.copy()
    while left.sum() > 20_000:
        one, room = np.zeros(len(lengths), np.int64), capacity
        for i in range(len(lengths) - 1, -1, -1):
            n = min(int(left[i]), room // int(lengths[i]))
            if n:
                one[i], room = n, room - n * int(lengths[i])
        used = one > 0
        times = int((left[used] // one[used]).min())
        out.append((one, times))
        left -= times * one
    return out + _best_fit_decreasing(lengths, left, capacity)


def windows(tokens: dict[int, int], capacity: int) -> dict[int, int]:
    """Window of each run of rows, by its place and tokens: consecutive, of about the same number of tokens."""
    total, before, out = sum(tokens.values()), 0, {}
    many = max(1, min(WINDOWS, total // (WINDOW_SEQUENCES * capacity)))
    for at in sorted(tokens):
        out[at] = min(many - 1, before * many // max(total, 1))
        before += tokens[at]
    return out


def _stride(n: int) -> int:
    """A step prime to n, near the golden section, so that its multiples modulo n are spread evenly and meet every number once."""
    step = max(1, round(n * 0.6180339887))
    while math.gcd(step, n) > 1:
        step += 1
    return step


#: Places of a window's pieces: those of a length with ranks from rank0 to rank1 lie, many to a sequence, from sequence0 on at offset0.
PLACES = T.StructType([T.StructField(f"p_{x}", T.LongType()) for x in ("window", "length", "rank0", "rank1", "many", "sequence0", "offset0", "all", "stride")])


def _placer(capacity: int, ordered: bool):
    """One window's histogram (window, length, n) to its PLACES; a task's work depends on the number of different lengths alone."""
    names = PLACES.names

    def place(histogram: pa.Table) -> pa.Table:
        window = histogram.column("window")[0].as_py()
        of = dict(zip(histogram.column("length").to_pylist(), histogram.column("n").to_pylist(), strict=True))
        found, said = programmed(of, capacity)
        print(f"packing: window {window}, {said['pieces']} pieces of {said['lengths']} lengths, share placed by the program {said['placed']:.4f}", file=sys.stderr)
        rows, sequence, before, many_here = [], 0, Counter(), sum(n for _, n in found)
        stride = _stride(many_here) if ordered else 1
        for one, n in found:
            offset = 0
            for length, many in sorted(one.items(), reverse=True):
                rows.append((window, length, before[length], before[length] + many * n, many, sequence, offset, many_here, stride))
                before[length] += many * n
                offset += length * many
            sequence += n
        assert before == Counter(of), "every piece has a place"
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return place


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, ordered: bool = False) -> DataFrame:
    """One row per piece with its sequence and offset.

    ordered: docs is a table whose files and rows are in the order of a
    schedule. Consecutive windows of it, at most WINDOWS, are packed apart, so
    that the sequences of a window come after all those of the one before;
    inside a window sequences of one configuration are spread evenly.
    """
    spark = docs.sparkSession
    pieces = durable(tokenised(docs, path, capacity, end, ordered), "pieces")
    pieces = pieces.withColumn("run", F.col("at") - F.col("at") % TOGETHER)
    if ordered:
        of = windows({r["run"]: r["n"] for r in pieces.groupBy("run").agg(F.sum("length").alias("n")).collect()}, capacity)
        own = spark.createDataFrame(list(of.items()), "run long, window int")
        pieces = pieces.join(F.broadcast(own), "run")  # a row per TOGETHER rows of a file
    else:
        pieces = pieces.withColumn("window", F.lit(0))
    counts = pieces.groupBy("window", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.repartitionByRange(WINDOWS, "window")  # a task for each window: their tables are small, the work on them isn't
    found = durable(counts.groupBy("window").applyInArrow(_placer(capacity, ordered), PLACES), "places")
    # a row per window, then its rows of lengths and configurations: neither grows with the corpus
    first, starts = 0, []
    for r in found.groupBy("p_window").agg(F.max("p_all").alias("n")).orderBy("p_window").collect():
        starts.append((r["p_window"], first))
        first += r["n"]
    places = found.join(F.broadcast(spark.createDataFrame(starts, "p_window long, p_first long")), "p_window")
    own = ranked(pieces, ["window", "length"], ["doc_id", "piece", "start", "ids_crc32"], ["doc_id", "piece"], few_keys=True)
    # its rows are bounded by the lengths in a configuration, not by the corpus
    same = (F.col("window") == F.col("p_window")) & (F.col("length") == F.col("p_length"))
    found = own.join(F.broadcast(places), same & (F.col("__rank") >= F.col("p_rank0")) & (F.col("__rank") < F.col("p_rank1")))
    inside = F.col("__rank") - F.col("p_rank0")
    within = (F.col("p_sequence0") + F.floor(inside / F.col("p_many"))).cast("long")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p_first") + within * F.col("p_stride") % F.col("p_all")).cast("long").alias("sequence_id"),
        (F.col("p_offset0") + (inside % F.col("p_many")) * F.col("length")).cast("long").alias("offset"),
    )
