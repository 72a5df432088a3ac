"""Secrets: patterns, and weak candidates that count only with their complements.

Patterns find assigned secrets, access identifiers and long hex strings. A
login, client id, mail address or an access identifier too short for the
pattern, a random-looking, short assigned or short hex string, a URL or a bare
host mean little alone; those that complete each other within a scope are a
leaked credential. Candidates are rows; scopes (a candidate widened by SCOPE
code points on both sides) are cut into cells, joined by document and cell, and
overlaps are kept. An identifier or a secret is reported if one of the other
lies in its scope, an endpoint if both do; parts that overlap don't complete
each other. Spans within a kind don't overlap, so the candidates of a cell have
a bound and pairs grow with the text.

Defined results: null text is empty and has no spans; repeated rows get the
same spans; a candidate that overlaps a pattern's span is not reported again
and completes nothing, nor does a run of digits alone; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import durable
from .near_dups import sparing, text_key
from .pii import EMAIL

KINDS = ("assign", "access", "hex", "identifier", "account", "short_access", "random", "short_assign", "short_hex", "endpoint", "host")
#: What each kind can be of a credential.
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "identifier", "account", "short_access"), ("assign", "hex", "random", "short_assign", "short_hex"), ("endpoint", "host")

#: The first as given; the others find what the plain patterns and lengths find.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"

#: Weak candidates.
IDENTIFIER = r"(?<![A-Za-z0-9])(?i:user_?name|user|login|client_?id|account_?id|access_?key_?id)[\x22']?\x20{0,8}[:=]\x20{0,8}[\x22']?([A-Za-z0-9._@-]{4,}+)"
RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ENDPOINT = r"(?<![A-Za-z])(?:https?|ftp|sftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\x22'<>]{4,}+"

SHORT_ACCESS = r"AKIA[A-Z0-9]{8,13}+(?![A-Z0-9])"
SHORT_HEX = r"(?<![0-9a-f])[0-9a-f]{12,15}+(?![0-9a-f])"
HOST = r"(?<![A-Za-z0-9.@/-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
HOST_ENDS = r"\.(?:com|net|org|io|dev|cloud|internal|local|example)$"

SCOPE, CELL = 200, 512

_TEXT = "coalesce(text, '')"
_SPANS = "array<struct<k:int,kind:string,s:int,e:int,v:string>>"


def _base(text: str) -> str:
    return spans.kinds({"assign": f"filter({spans.found(text, ASSIGN, 1)}, x -> length(x.v) >= 12)", "access": spans.found(text, ACCESS), "hex": spans.found(text, HEX)})


def _weak(text: str) -> str:
    mixed = "x.v RLIKE '[0-9]' AND x.v RLIKE '[a-z]' AND x.v RLIKE '[A-Z]'"
    return spans.kinds({
        "identifier": spans.found(text, IDENTIFIER), "account": spans.found(text, EMAIL), "short_access": spans.found(text, SHORT_ACCESS),
        "random": f"filter({spans.found(text, RANDOM)}, x -> {mixed})",
        "short_assign": f"filter({spans.found(text, ASSIGN, 1)}, x -> length(x.v) BETWEEN 8 AND 11)",
        "short_hex": f"filter({spans.found(text, SHORT_HEX)}, x -> x.v RLIKE '[0-9]' AND x.v RLIKE '[a-f]')",
        "endpoint": spans.found(text, ENDPOINT), "host": f"filter({spans.found(text, HOST)}, x -> x.v RLIKE r'{HOST_ENDS}')",
    }, 3)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key, base, weak: one pass over each whole text."""
    rows = docs.select("doc_id", "text").withColumn("key", text_key())
    # v says why a span completes nothing: a number is found as hex, but isn't a secret's half
    lean = "transform({0}, x -> named_struct('k', x.k, 'kind', x.kind, 's', x.s, 'e', x.e, 'v', CASE WHEN x.kind = 'hex' AND NOT x.v RLIKE '[a-f]' THEN 'number' ELSE '' END))"
    return rows.selectExpr("doc_id", "key", f"inline(transform(array({_base(_TEXT)}), b -> named_struct('base', {lean.format('b')}, 'weak', {lean.format(_weak(_TEXT))})))")


def linked(found: DataFrame, scope: int = SCOPE, cell: int = CELL) -> DataFrame:
    """(doc_id, key, more): spans of the weak candidates that have their complements within scope."""
    part = found.where("size(weak) > 0").distinct().select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("x")).select("doc_id", "key", "x.*")
    part = durable(part, "parts")

    def cells(rows: DataFrame, wide: int) -> DataFrame:
        return rows.withColumn("cell", F.explode(F.expr(f"sequence(greatest(s - {wide}, 0) DIV {cell}, (e - 1 + {wide}) DIV {cell})")))

    def met(rows: DataFrame, others: DataFrame, wide: int, how: Callable[[DataFrame], Column]) -> DataFrame:
        """The rows that meet one of others, of the same document, within wide, in the way how says; by cells, so never all against all."""
        other = cells(others, 0).select(F.col("doc_id").alias("d2"), F.col("key").alias("k2"), F.col("cell").alias("c2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
        mine = cells(rows, wide)
        same = mine["doc_id"].eqNullSafe(F.col("d2")) & (mine["key"] == F.col("k2")) & (mine["cell"] == F.col("c2"))
        return mine.join(other, same & how(mine), "left_semi").select("doc_id", "key", "k", "kind", "s", "e").distinct()

    weak = part.where("k >= 3")
    hidden = met(weak, part.where("k < 3"), 0, lambda r: (F.col("s2") < r["e"]) & (F.col("e2") > r["s"]))
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("doc_id", "key", "kind", "s", "e")]
    weak = durable(weak.alias("w").join(hidden.alias("h"), reduce(lambda a, b: a & b, on), "left_anti"), "weak")
    every = durable(part.where("k < 3").unionByName(weak), "every")

    def near(wanted: tuple[str, ...], these: tuple[str, ...]) -> DataFrame:
        """The weak candidates of the kinds wanted that have one of these in their scope, beside them."""
        beside = lambda r: ((F.col("s2") >= r["e"]) & (F.col("s2") < r["e"] + scope)) | ((F.col("e2") <= r["s"]) & (F.col("e2") > r["s"] - scope))
        return met(weak.where(F.col("kind").isin(*wanted)), every.where(F.col("kind").isin(*these) & (F.col("v") == "")), scope, beside)

    both = near(ENDPOINTS, IDENTIFIERS).intersect(near(ENDPOINTS, SECRETS))
    kept = near(IDENTIFIERS, SECRETS).unionByName(near(SECRETS, IDENTIFIERS)).unionByName(both)
    one = F.struct("k", "kind", "s", "e", F.lit("").alias("v"))
    return kept.groupBy("doc_id", "key").agg(F.collect_list(one).cast(_SPANS).alias("more"))


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of pattern spans, a digest of them, and all spans with the linked candidates, by start."""
    found = durable(scanned(docs), "scanned")
    more = durable(linked(found, scope), "linked")
    small = sparing(more, more.count()).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "more")
    rows = found.join(small, found["doc_id"].eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    by_start = "transform(sort_array(transform({0}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', x.kind))), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"
    every = f"concat(base, coalesce(more, cast(array() AS {_SPANS})))"
    return rows.selectExpr(
        "doc_id", *[f"{spans.many('base', k)} AS n_{k}" for k in KINDS[:3]],
        f"sha2({spans.digest(by_start.format('base'))}, 256) AS base_sha256", f"{spans.digest(by_start.format(every))} AS spans",
    )
