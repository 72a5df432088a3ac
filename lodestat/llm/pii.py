"""Personal data: patterns, and the terms in their documents that give the same person away.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.
The information-theoretic part asks what a reader learns about a protected
entity from the other words of its documents: one such value, or the class that
many persons share (mail domain, network of an address, issuer of a card, area
of a phone number). Over the whole corpus,

    disclosure(term, entity) = PMI(term; entity) / IC(entity)
                             = 1 - ln(docs(term) / docs(term, entity)) / ln(docs / docs(entity))

is 1 for a term that occurs with the entity only and falls as it occurs
elsewhere; docs() counts whole documents. In every document of the entity,
each place of a term at or above generalise_at is generalised to a class mark
and of one at or above remove_at is removed. A pair must also be met more
often than independent words would with probability chance, over all pairs
that are judged, and in two different texts at least. Documents without
a protected value are left as they are.

Everything is column expressions and joins. Defined results: null text is
empty and has no spans; repeated rows get the same spans; in a corpus where
every document holds the entity its information content is 0 and no term is
judged; an empty table gives an empty result. Extra columns keep their values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import durable, folded
from .near_dups import sparing, text_key

KINDS = ("email", "ip", "card", "phone", "general", "remove")

#: Each finds what the plain patterns find: lookbehind and possessive parts only keep the scan linear on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Runs of letters and digits, three or more; two of scripts that write names so.
TERM = r"[\p{L}\p{N}]{3,}+|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}+"
DIGITS = "regexp_replace({0}, '[^0-9]', '')"

#: Chance, over all pairs judged, that one is met so often without dependence; then the limits of disclosure.
CHANCE, GENERALISE_AT, REMOVE_AT = 0.001, 0.9, 0.97

_TEXT = "coalesce(text, '')"
_SPANS = "array<struct<k:int,kind:string,s:int,e:int,v:string>>"


def _base(text: str) -> str:
    digits = DIGITS.format("x.v")
    low = "forall(split(x.v, '[.]'), q -> length(regexp_replace(q, '^0+', '')) <= 3 AND cast(concat('0', right(q, 3)) AS int) <= 255)"
    luhn = (
        f"transform(array(reverse({digits})), d -> length(d) BETWEEN 13 AND 19 AND aggregate(transform(sequence(1, length(d)), "
        "i -> cast(substr(d, i, 1) AS int) * (2 - i % 2)), 0, (a, y) -> a + y - CASE WHEN y > 9 THEN 9 ELSE 0 END) % 10 = 0)[0]"
    )
    return spans.kinds({
        "email": spans.found(text, EMAIL),
        "ip": f"filter({spans.found(text, IP)}, x -> {low})",
        "card": f"filter({spans.found(text, CARD)}, x -> {luhn})",
        "phone": f"filter({spans.found(text, PHONE)}, x -> length({digits}) BETWEEN 9 AND 15)",
    })


def _entities(b: str) -> str:
    """What the spans of b give away, once each: the values in one spelling, and the class of each, which many persons share."""
    digits = DIGITS.format("x.v")
    value = f"concat(x.kind, ':', CASE WHEN x.kind IN ('card', 'phone') THEN {digits} ELSE lower(x.v) END)"
    of = {"email": "concat('domain:', lower(substring_index(x.v, '@', -1)))", "ip": "concat('network:', substring_index(x.v, '.', 2))", "card": f"concat('issuer:', left({digits}, 6))"}
    class_ = f"CASE {' '.join(f'WHEN x.kind = {chr(39)}{k}{chr(39)} THEN {c}' for k, c in of.items())} ELSE concat('area:', left({digits}, 4)) END"
    return f"array_distinct(flatten(transform({b}, x -> array({value}, {class_}))))"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key, base (pattern spans), entities (the values they hold); one pass."""
    rows = docs.select("doc_id", "text").withColumn("key", text_key())
    return rows.selectExpr("doc_id", "key", f"inline(transform(array({_base(_TEXT)}), b -> named_struct('base', b, 'entities', {_entities('b')})))")


def _holding(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of docs, as key, text and marks' own columns, that marks (one row per doc_id and key) knows."""
    small = sparing(marks, marks.count()).withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    rows = docs.select("doc_id", "text").withColumn("key", text_key())
    return rows.join(small, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).drop("__id", "__key")


def _said(found: DataFrame) -> DataFrame:
    return found.where("size(entities) > 0").select("doc_id", "key", F.explode("entities").alias("entity"))


_WORDS = rf"array_distinct(regexp_extract_all(lower({_TEXT}), r'{TERM}', 0))"


def _beside(docs: DataFrame, found: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, key, entity, term): the different words of each document that holds one of entities. A second pass over those documents alone."""
    holds = _said(found).distinct().join(sparing(entities, entities.count()), "entity").groupBy("doc_id", "key").agg(F.collect_list("entity").alias("own"))
    rows = _holding(docs, durable(holds, "holds")).select("doc_id", "key", F.explode("own").alias("entity"), F.expr(_WORDS).alias("words"))
    return rows.select("doc_id", "key", "entity", F.explode("words").alias("term"))


def disclosing(docs: DataFrame, found: DataFrame, chance: float = CHANCE, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above generalise_at; counts are of documents (rows), over the whole texts of all of docs."""
    each = _said(found)
    entities = each.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"), F.countDistinct("key").alias("texts"))
    entities = durable(entities.where("texts >= 2").select("entity", "with_entity"), "entities")  # one text is no evidence for any term
    near = _beside(docs, found, entities.select("entity"))
    # copies of a text count once as evidence: rows of a text are summed first, so that no group holds a hot text's rows
    pairs = near.groupBy("entity", "term", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts"))
    pairs = durable(pairs.where("texts >= 2"), "near")
    said = docs.select(F.explode(F.expr(_WORDS)).alias("term"))
    # all words are counted, each task's first by itself; a join with the wanted ones before that would grow faster than the corpus
    with_term = said.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    total = docs.count()
    rated = pairs.join(with_term, "term").join(entities, "entity")
    p, q, n = F.col("with_entity") / F.lit(float(max(total, 1))), F.col("both") / F.col("with_term"), F.col("with_term")
    content = -F.log(p)
    rate = 1 + F.log(F.least(q, F.lit(1.0))) / F.nullif(content, F.lit(0.0))
    # Chernoff's bound on the chance that so many of the term's documents hold the entity if they don't depend on each other; copies of a text count once
    apart = F.when(q < 1, (1 - q) * F.log((1 - q) / F.nullif(1 - p, F.lit(0.0)))).otherwise(0.0)
    evidence = n * (q * F.log(q / p) + apart) * F.col("texts") / F.col("both")
    sure = evidence >= math.log(max(pairs.count(), 1) / chance)
    return durable(rated.where(sure & (q > p)).select("entity", "term", rate.alias("disclosure")).where(F.col("disclosure") >= generalise_at), "disclosing")


def term_spans(docs: DataFrame, found: DataFrame, disclosed: DataFrame, remove_at: float = REMOVE_AT) -> DataFrame:
    """(doc_id, key, terms): every place of a disclosing term in the documents of its entity, outside pattern spans, by place."""
    near = _beside(docs, found, disclosed.select("entity").distinct())
    hit = near.join(sparing(disclosed, disclosed.count()), ["entity", "term"]).groupBy("doc_id", "key", "term").agg(F.max("disclosure").alias("d"))
    marks = durable(hit.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("__d")), "marks")
    free = f"filter({spans.found(_TEXT, TERM)}, t -> map_contains_key(__d, lower(t.v)) AND NOT exists(b, y -> t.s < y.e AND t.e > y.s))"
    one = f"transform({free}, t -> named_struct('k', CASE WHEN __d[lower(t.v)] >= {remove_at} THEN 5 ELSE 4 END, 'kind', CASE WHEN __d[lower(t.v)] >= {remove_at} THEN 'remove' ELSE 'general' END, 's', t.s, 'e', t.e, 'v', lower(t.v)))"
    rows = _holding(docs, marks).selectExpr("doc_id", "key", f"transform(array({_base(_TEXT)}), b -> {one})[0] AS terms")
    return rows.groupBy("doc_id", "key").agg(F.first("terms").cast(_SPANS).alias("terms"))  # repeated rows have the same


def report(docs: DataFrame, chance: float = CHANCE, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """One row per document: counts of pattern spans, a digest of them, and all spans with the disclosing terms."""
    found = durable(scanned(docs), "scanned")
    terms = durable(term_spans(docs, found, disclosing(docs, found, chance, generalise_at), remove_at), "spans")
    small = sparing(terms, terms.count()).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "terms")
    rows = found.join(small, found["doc_id"].eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    every = f"concat(base, coalesce(terms, cast(array() AS {_SPANS})))"
    return rows.selectExpr(
        "doc_id", *[f"{spans.many('base', k)} AS n_{k}" for k in KINDS[:4]],
        f"sha2({spans.digest('base')}, 256) AS base_sha256", f"{spans.digest(every)} AS spans",
    )


def sanitised(docs: DataFrame, chance: float = CHANCE, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """docs with class marks in the place of personal data; n_chars, if there, follows a text that changed."""
    found = durable(scanned(docs), "scanned")
    terms = durable(term_spans(docs, found, disclosing(docs, found, chance, generalise_at), remove_at), "spans")
    small = sparing(terms, terms.count()).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key2"), F.col("terms").alias("__terms"))
    keyed = folded(docs, "doc_id", "text").withColumn("__key", text_key())
    known = keyed.join(small, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__key2")), "left")
    every = f"concat({_base('text')}, coalesce(__terms, cast(array() AS {_SPANS})))"
    mark = "CASE x.kind WHEN 'remove' THEN '' WHEN 'general' THEN '[TERM]' ELSE concat('[', upper(x.kind), ']') END"
    clean = f"inline(transform(array(transform(array({every}), z -> CASE WHEN size(z) > 0 THEN {spans.replaced('text', 'z', mark)} ELSE text END)[0]), t -> named_struct('__clean', t)))"
    rows = known.selectExpr("__doc", "text", clean)
    own = {c: F.col(f"__doc.`{c}`").alias(c) for c in docs.columns} | {"text": F.col("__clean").alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("__clean").eqNullSafe(F.col("text")), F.col("__doc.n_chars")).otherwise(F.length("__clean").cast(kind)).alias("n_chars")
    return rows.select(*[own[c] for c in docs.columns])
