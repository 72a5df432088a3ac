"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering.

Everything on the main path is a DataFrame aggregate or a column expression.
A rule is grown one condition at a time (the condition with the best
information gain on the growing part), cut back to those of its conditions that
do best on the pruning part, and kept only if it is precise there; rows that it
covers leave the table and the next rule is grown. The list ends as one CASE
expression. Learned from are labelled rows that pass the base rule and whose
crc32(doc_id as text) mod 5 is not 0; the others are left to judge it by.

Defined results: a null or empty text has no words, so it fails the base rule
and is not kept. Repeated rows are judged each by itself. Empty tables, tables
with no label or one class give an empty list, which keeps every row that
passes the base rule. Of an id with several texts the least is learned from. Only doc_id and text are read, so other columns may
bear any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, folded, labelled, learned_from

#: Words of a window, and the base rule's two limits.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30

#: Document statistics that rules may test: ratios that don't drift with length, as the share of distinct words would.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "adjacent_share": "n_adjacent / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'<=' if self.at_most else '>'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return "(" + " AND ".join(c.sql() for c in self.conditions) + ")"


def _repeat_sql(w: str) -> str:
    """Words inside windows that occur twice or more: hash windows, sort (hash, place), take neighbours with one hash, count covered places."""
    k = WINDOW
    placed = "sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))"
    places = (
        "array_sort_ints(filter(transform(s, (e, j) -> CASE WHEN (j > 0 AND s[j - 1].x = e.x) OR (j + 1 < size(s) AND s[j + 1].x = e.x) THEN e.i END), q -> q IS NOT NULL))"
    ).replace("array_sort_ints", "sort_array")
    covered = f"aggregate(p, named_struct('n', 0L, 'last', -{k}), (a, q) -> named_struct('n', a.n + least({k}, q - a.last), 'last', q), a -> a.n)"
    again = f"transform(array({placed}), s -> transform(array({places}), p -> {covered})[0])[0]"
    hashes = f"transform(sequence(1, size({w}) - {k - 1}), i -> xxhash64(slice({w}, i, {k})))"
    return f"CASE WHEN size({w}) < {k} THEN 0L ELSE transform(array({hashes}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {again} END)[0] END"


def statistics(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, others and one column for each count; one pass over each text, by a generator so that no count is worked out twice."""
    text = "coalesce(text, '')"
    lines = rf"filter(split({text}, '\n', -1), l -> l RLIKE r'{WORD}')"
    made = f"""inline(transform(array(regexp_extract_all({text}, r'{WORD}', 0)), w -> named_struct(
        'n_words', cast(size(w) AS long),
        'word_chars', cast(length(array_join(w, '')) AS long),
        'n_symbols', cast(regexp_count({text}, r'[#*$%&|<>]') AS long),
        'n_dup_lines', cast(transform(array({lines}), x -> size(x) - size(array_distinct(x)))[0] AS long),
        'n_repeat_words', {_repeat_sql('w')},
        'n_lines', cast(1 + length({text}) - length(replace({text}, '\\n', '')) AS long),
        'n_upper', cast(regexp_count({text}, r'\\p{{Lu}}') AS long),
        'n_marks', cast(regexp_count({text}, r'[!?;:^~_=+]') AS long),
        'n_adjacent', cast(regexp_count({text}, r'(?<![^\\x20\\x09-\\x0D])([^\\x20\\x09-\\x0D]++)(?=[\\x20\\x09-\\x0D]++\\1(?![^\\x20\\x09-\\x0D]))') AS long)
    )))""".replace("\\\\", "\\")
    return docs.selectExpr("doc_id", *others, made)


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words")


def training_table(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Statistics of at most bound labelled documents that pass the base rule; the ids are broadcast, their number being bounded."""
    rows = statistics(learned_from(docs, labelled(labels, "quality", bound)), "__y").where(~base_failed())
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(3)) == 0
    return rows.selectExpr("__y", "doc_id", *[f"cast({e} AS double) AS {f}" for f, e in FEATURES.items()]).withColumn("__prune", part).drop("doc_id")


def _cuts(values: list[float]) -> list[float]:
    """Both classes' quantiles and the midpoints between them, so that a cut can stand clear of either class."""
    own = sorted(set(values))
    return sorted({*own, *((a + b) / 2 for a, b in zip(own, own[1:], strict=False))})


def learn(docs: DataFrame, labels: DataFrame, bound: int = 20_000, most_rules: int = 8, most_conditions: int = 3, least_precision: float = 0.9, least_covered: int = 12, cuts: int = 24) -> list[Rule]:
    """Sequential covering for the class quality = 0. bound: labelled documents that are used, a parameter, not a share of the corpus."""
    rows = durable(training_table(docs, labels, bound), "rules")
    shares = ", ".join(str((i + 1) / (cuts + 1)) for i in range(cuts))
    per_class = rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"percentile_approx({f}, array({shares}), 10000)").alias(f) for f in FEATURES]).collect()
    if len(per_class) < 2:
        return []
    edges = {f: _cuts([float(t) for r in per_class for t in r[f]]) for f in FEATURES}
    binned = rows
    for f, cut in edges.items():  # a value's bin is the number of thresholds below it
        binned = binned.withColumn(f"__b_{f}", F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cut)}), c -> c < {f}))"))
    binned = durable(binned.select("__y", "__prune", *[f"__b_{f}" for f in edges]).groupBy("__y", "__prune", *[f"__b_{f}" for f in edges]).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "bins")

    def counts(rest: DataFrame) -> dict:
        """(feature, bin, pruning part, class) -> rows, from one aggregate."""
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"__b_{f}").alias("b")) for f in edges])).alias("p")
        found = rest.select("__y", "__prune", "n", pairs).groupBy("p.f", "p.b", "__prune", "__y").agg(F.sum("n").alias("n"))
        return {(r["f"], r["b"], r["__prune"], r["__y"]): r["n"] for r in found.collect()}

    def covers(c: Condition) -> Column:
        place = edges[c.feature].index(c.threshold)
        return F.col(f"__b_{c.feature}") <= place if c.at_most else F.col(f"__b_{c.feature}") > place

    def all_of(conditions: tuple[Condition, ...]) -> Column:
        return reduce(lambda a, b: a & b, map(covers, conditions))

    def pruned(rest: DataFrame, grown: list[Condition]) -> tuple[tuple[Condition, ...], float, int]:
        """The conditions of grown, any of them, that do best on the pruning part (the fewest on ties), their precision there and all rows they cover."""
        some = [c for n in range(1, len(grown) + 1) for c in combinations(grown, n)]
        sums = []
        for i, c in enumerate(some):
            hit = all_of(c)
            sums += [F.sum(F.when(hit & F.col("__prune") & (F.col("__y") == y), F.col("n")).otherwise(0)).alias(f"p{i}_{y}") for y in (0, 1)]
            sums.append(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"n{i}"))
        got = rest.agg(*sums).first()
        worth = []
        for i, c in enumerate(some):
            b, g = got[f"p{i}_0"] or 0, got[f"p{i}_1"] or 0
            worth.append(((b - g) / (b + g) if b + g else -1.0, b, -len(c), -i, b / (b + g) if b + g else 0.0, got[f"n{i}"] or 0))
        best = max(worth)
        return some[-best[3]], best[4], best[5]

    rules: list[Rule] = []
    rest = binned
    for _ in range(most_rules):
        grown: list[Condition] = []
        inside = rest
        for _ in range(most_conditions):
            found = counts(inside)
            one = next(iter(edges))
            total = {(p, y): sum(n for (f, _, q, z), n in found.items() if f == one and q == p and z == y) for p in (False, True) for y in (0, 1)}
            bad, good = total[False, 0], total[False, 1]
            if not bad or not good:
                break
            tried = []
            for f, cut in edges.items():
                for place, threshold in enumerate(cut):
                    for at_most in (True, False):
                        hit = {(p, y): sum(n for (g, b, q, z), n in found.items() if g == f and q == p and z == y and (b <= place) == at_most) for p in (False, True) for y in (0, 1)}
                        b, g = hit[False, 0], hit[False, 1]
                        if b < least_covered or (b + g) == (bad + good):
                            continue
                        gain = b * (math.log2((b + 1) / (b + g + 2)) - math.log2((bad + 1) / (bad + good + 2)))
                        tried.append((gain, Condition(f, at_most, threshold), hit))
            best = max(tried, key=lambda x: x[0], default=None)
            if best is None or best[0] <= 0:
                break
            # of the same feature's cuts that do nearly as well, the one that rejects least
            alike = [x for x in tried if x[1].feature == best[1].feature and x[1].at_most == best[1].at_most and x[0] >= 0.97 * best[0]]
            best = min(alike, key=lambda x: x[1].threshold if best[1].at_most else -x[1].threshold)
            grown.append(best[1])
            inside = inside.where(covers(best[1]))
        if not grown:
            break
        kept, precision, covered = pruned(rest, grown)
        if precision < least_precision or covered < least_covered:
            break
        rules.append(Rule(kept, precision, covered))
        rest = rest.where(~all_of(kept))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that covers a row rejects it; the default keeps it."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN false" for r in rules) + " ELSE true END")


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and rule: 0 for the base rule, else the place of the rule that rejects, null if kept."""
    rows = statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    place = "CASE WHEN base_failed THEN 0 " + " ".join(f"WHEN {r.sql()} THEN {i + 1}" for i, r in enumerate(rules)) + " END"
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"), F.expr(place).cast("int").alias("rule"))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the list keeps, with their own columns."""
    rows = statistics(folded(docs, "doc_id", "text"), "__doc").withColumn("base_failed", base_failed())
    return rows.where(~F.col("base_failed") & verdict(rules)).select("__doc.*")
