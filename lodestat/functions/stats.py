"""Statistical kernels. A DataFrame plan brings each test down to a few sufficient statistics per group of rows; tails are worked out from those.

Plans take a long frame with the grouping column given by `by` (for instance
one row per factor and value), so many tests share one job. Degenerate input
gives null, never an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix, special


def finite(c: str) -> Column:
    """The column as a double, null where it is no finite number."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def benjamini_hochberg(df: DataFrame, p: str = "p_value", family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """df with q and rejected: q(i) = min over j >= i of p(j) * m / j, at most 1. Null and NaN p stay null and out of m.

    One row per test: a family fits one task.
    """
    ok = F.when(~F.isnan(p), F.col(p))
    each = [F.col(c) for c in family] or [F.lit(1)]
    rows = df.withColumn("__p", ok)
    in_family = Window.partitionBy(*each, F.col("__p").isNull())
    upward = in_family.orderBy("__p")
    raw = F.col("__p") * F.count("__p").over(in_family) / F.row_number().over(upward)
    rows = rows.withColumn("__r", raw)
    q = F.least(F.lit(1.0), F.min("__r").over(upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = rows.withColumn("q", F.when(F.col("__p").isNotNull(), q))
    # equal p share the least of their q
    return out.withColumn("q", F.min("q").over(Window.partitionBy(*each, "__p"))).withColumn("rejected", F.coalesce(F.col("q") <= alpha, F.lit(False))).drop("__p", "__r")


def two_groups(flat: DataFrame, by: Sequence[str], side: str, value: str = "value") -> DataFrame:
    """by, then n, mean and sample variance of the rows with side (a) and without (b)."""
    x = finite(value)
    a, b = F.when(F.col(side), x), F.when(~F.col(side), x)
    return flat.groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"), F.median(a).alias("median_a"), F.median(b).alias("median_b"))


def cohens_d() -> Column:
    """From two_groups: mean difference by the pooled deviation; null under two rows a side or without spread."""
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0))
    return F.when((F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (pooled > 0), (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled))


def welch() -> tuple[Column, Column]:
    """From two_groups: t and its degrees of freedom."""
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    good = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (sa + sb > 0)
    t = F.when(good, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(sa + sb))
    return t, F.when(good, (sa + sb) * (sa + sb) / (sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)))


def welch_ttest(row: dict, alpha: float = 0.05) -> dict:
    """The finished test from a row of two_groups."""
    n, m = row["n_a"], row["n_b"]
    sa, sb = ((row[f"var_{g}"] or 0.0) / max(row[f"n_{g}"], 1) for g in "ab")
    if n < 2 or m < 2 or sa + sb <= 0:
        return {"t": None, "df": None, "p_value": None, "ci95": None, "note": "too few rows or no spread"}
    diff = row["mean_a"] - row["mean_b"]
    t, df = diff / math.sqrt(sa + sb), (sa + sb) ** 2 / (sa * sa / (n - 1) + sb * sb / (m - 1))
    half = special.t_quantile(1 - alpha / 2, df) * math.sqrt(sa + sb)
    pooled = ((n - 1) * row["var_a"] + (m - 1) * row["var_b"]) / (n + m - 2)
    return {"t": t, "df": df, "p_value": special.two_sided_t(t, df), "mean_diff": diff, "ci95": (diff - half, diff + half), "cohens_d": diff / math.sqrt(pooled) if pooled > 0 else None}


def mean_diff_ci(row: dict, alpha: float = 0.05) -> tuple[float, float] | None:
    return welch_ttest(row, alpha)["ci95"]


def tied(t: Column) -> Column:
    """t^3 - t of a count, as a double: the cube of 2.1 million rows is beyond a long."""
    t = t.cast("double")
    return t * (t * t - 1)


def mann_whitney_u(flat: DataFrame, by: Sequence[str], side: str, value: str = "value") -> DataFrame:
    """by, n_a, n_b, u (of the rows with side), ties (sum of t^3 - t), rank_biserial. Ranks come from counts of distinct values."""
    rows = flat.withColumn("__v", finite(value)).where("__v is not null")
    hist = rows.groupBy(*by, "__v").agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    run = prefix.running(hist, by, "__v", ["b"])
    out = run.groupBy(*by).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * (F.col("b__before") + F.col("b") / 2)).alias("u"), F.sum(tied(F.col("a") + F.col("b"))).alias("ties"))
    return out.withColumn("rank_biserial", F.try_divide(2 * F.col("u"), F.col("n_a").cast("double") * F.col("n_b")) - 1)


def mann_whitney_p(u: float | None, n_a: int, n_b: int, ties: float) -> float | None:
    """Two-sided, normal with tie and continuity correction; exact for small samples without ties."""
    if u is None or not n_a or not n_b:
        return None
    n = n_a + n_b
    if min(n_a, n_b) <= 8 and not ties and n <= 60:
        ways = [1] + [0] * (n_a * n_b)
        for j in range(1, n_a + 1):  # the generating function of U: product of (1 - q^(n_b + j)) / (1 - q^j)
            for k in range(n_a * n_b, n_b + j - 1, -1):
                ways[k] -= ways[k - n_b - j]
            for k in range(j, n_a * n_b + 1):
                ways[k] += ways[k - j]
        top = max(u, n_a * n_b - u)
        return min(1.0, 2 * sum(ways[math.ceil(top) :]) / sum(ways))
    var = n_a * n_b / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return None
    return min(1.0, 2 * special.normal_sf((abs(u - n_a * n_b / 2) - 0.5) / math.sqrt(var)))


def chi_square(flat: DataFrame, by: Sequence[str], row: str, column: str) -> DataFrame:
    """by, n, n_rows, n_cols, chi2 (no continuity correction), dof, cramers_v. Empty rows and columns don't occur in the sparse table.

    With O, R, C and N the counts, chi2 = N * (sum of O^2 / (R * C) - 1), so zero cells needn't be made.
    """
    cells = flat.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*by, row, column).agg(F.count(F.lit(1)).alias("o"))
    in_row, in_col = Window.partitionBy(*by, row), Window.partitionBy(*by, column)
    cells = cells.withColumn("r", F.sum("o").over(in_row)).withColumn("c", F.sum("o").over(in_col))
    got = cells.groupBy(*by).agg(F.sum("o").alias("n"), F.countDistinct(row).alias("n_rows"), F.countDistinct(column).alias("n_cols"), F.sum(F.col("o").cast("double") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"))
    good = (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2)
    chi2 = F.when(good, F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1)))
    out = got.withColumn("chi2", chi2).withColumn("dof", F.when(good, (F.col("n_rows") - 1) * (F.col("n_cols") - 1)))
    v = F.sqrt(F.col("chi2") / F.nullif(F.col("n") * (F.least("n_rows", "n_cols") - 1), F.lit(0)))
    return out.withColumn("cramers_v", v).drop("s")


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r over complete pairs; null under three pairs or without spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0) & (F.count(a) >= 3)
    return F.when(spread, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def correlation_p(r: float | None, n: int) -> float | None:
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else special.two_sided_t(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """df with the average rank of value among the rows of the same by."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__t"))
    run = prefix.running(hist, by, value, ["__t"])
    return df.join(run.select(*by, value, (F.col("__t__before") + (F.col("__t") + 1) / 2).alias(out)), [*by, value])


def spearman(flat: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, n, rho over complete pairs; null under three pairs or without spread.

    Equal pairs are counted before anything is joined: a column of few values
    leaves few rows, and the mean of average ranks is (n + 1) / 2 exactly.
    """
    rows = flat.select(*by, finite(x).alias("__x"), finite(y).alias("__y")).where("__x is not null and __y is not null")
    pairs = rows.groupBy(*by, "__x", "__y").agg(F.count(F.lit(1)).alias("__w"))

    def ranks(value: str, out: str) -> DataFrame:
        run = prefix.running(pairs.groupBy(*by, value).agg(F.sum("__w").alias("__t")), by, value, ["__t"])
        return run.select(*by, value, (F.col("__t__before") + (F.col("__t") + 1) / 2).alias(out))

    sizes = pairs.groupBy(*by).agg(F.sum("__w").alias("n"))
    ranked = pairs.join(ranks("__x", "__rx"), [*by, "__x"]).join(ranks("__y", "__ry"), [*by, "__y"]).join(sizes, list(by))
    a, b = F.col("__rx") - (F.col("n") + 1) / 2, F.col("__ry") - (F.col("n") + 1) / 2
    got = ranked.groupBy(*by, "n").agg(*[F.sum(F.col("__w") * z).alias(c) for c, z in (("ab", a * b), ("aa", a * a), ("bb", b * b))])
    return got.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


def kruskal(flat: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """by, n, n_groups, h (tie corrected), dof, effect = max(0, (h - k + 1) / (n - k))."""
    rows = flat.select(*by, F.col(group).alias("__g"), finite(value).alias("__v")).where("__g is not null and __v is not null")
    ranked = average_ranks(rows, by, "__v", "__r")
    ties = rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(tied(F.col("t"))).alias("ties"))
    groups = ranked.groupBy(*by, "__g").agg(F.count(F.lit(1)).alias("n"), F.sum("__r").alias("s"))
    got = groups.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).join(ties, list(by))
    n = F.col("n").cast("double")
    fix = 1 - F.col("ties") / F.nullif(n * n * n - n, F.lit(0.0))
    h = F.when((F.col("n_groups") >= 2) & (fix > 0), (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / fix)
    out = got.withColumn("h", h).withColumn("dof", F.when(F.col("h").isNotNull(), F.col("n_groups") - 1))
    return out.withColumn("effect", F.greatest(F.lit(0.0), (F.col("h") - F.col("n_groups") + 1) / F.nullif(n - F.col("n_groups"), F.lit(0.0)))).drop("q", "ties")


def collapse(df: DataFrame, cluster: str, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per cluster: x, its positive and negative rows, and whether x is constant in it. Unlabelled rows count for nothing."""
    rows = df.where(F.col(cluster).isNotNull() & F.col(x).isNotNull() & F.col(y).isin(0, 1))
    return rows.groupBy(*by, F.col(cluster).alias("cluster")).agg(F.min(x).alias("x"), F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"), (F.min(x) != F.max(x)).alias("varies"))


def _numeric_statistic(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    p, n = F.sum("n_pos"), F.sum("n_neg")
    return rows.groupBy(*by).agg((F.sum(F.col("x") * F.col("n_pos")) / F.nullif(p, F.lit(0)) - F.sum(F.col("x") * F.col("n_neg")) / F.nullif(n, F.lit(0))).alias("statistic"))


def _categorical_statistic(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    cat = rows.groupBy(*by, "x").agg(F.sum("n_pos").cast("double").alias("p"), F.sum("n_neg").cast("double").alias("q"))
    got = cat.groupBy(*by).agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.count(F.lit(1)).alias("k"), F.sum(F.col("p") * F.col("p") / (F.col("p") + F.col("q"))).alias("sp"), F.sum(F.col("q") * F.col("q") / (F.col("p") + F.col("q"))).alias("sq"))
    s = F.col("sp") / F.nullif(F.col("tp"), F.lit(0.0)) + F.col("sq") / F.nullif(F.col("tq"), F.lit(0.0)) - 1
    return got.select(*by, F.when(F.col("k") >= 2, F.sqrt(F.greatest(F.lit(0.0), s))).alias("statistic"))


def cluster_permutation(df: DataFrame, cluster: str, x: str, y: str, n_perm: int = 1000, seed: int = 0, kind: str = "numeric") -> dict:
    """Do clusters with positives have other values of x than a shuffle of x between clusters gives?

    Units collapse to clusters first, so a permutation costs clusters, not
    units: permutations x clusters rows, shuffled in rank order of a hash.
    p = (1 + #{|null| >= |observed| - 1e-12}) / (1 + n_perm).
    """
    rows = collapse(df, cluster, x, y).cache()
    try:
        seen = rows.agg(F.count(F.lit(1)).alias("k"), F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n"), F.count_if("varies").alias("v"), F.countDistinct("x").alias("u")).first()
        note = "no rows" if not seen["k"] else "fewer than 4 clusters" if seen["k"] < 4 else "single class" if not seen["p"] or not seen["n"] else "factor varies within clusters" if seen["v"] else "single value" if seen["u"] < 2 else None
        if note:
            return {"statistic": None, "p_value": None, "n_clusters": seen["k"], "note": note}
        statistic = _numeric_statistic if kind == "numeric" else _categorical_statistic
        observed = statistic(rows.withColumn("perm", F.lit(-1)), ["perm"]).first()["statistic"]
        perms = df.sparkSession.range(n_perm).select(F.col("id").alias("perm"))
        every = rows.select("cluster", "x", "n_pos", "n_neg").crossJoin(F.broadcast(perms))
        own = Window.partitionBy("perm").orderBy("cluster")
        mixed = Window.partitionBy("perm").orderBy(F.xxhash64(F.lit(seed), "perm", "cluster"), "cluster")
        slots = every.select("perm", "n_pos", "n_neg", F.row_number().over(own).alias("i"))
        values = every.select("perm", "x", F.row_number().over(mixed).alias("i"))
        null = statistic(slots.join(values, ["perm", "i"]), ["perm"])
        extreme = null.agg(F.count_if(F.abs("statistic") >= abs(observed) - 1e-12).alias("e")).first()["e"]
        return {"statistic": observed, "p_value": (1 + extreme) / (1 + n_perm), "n_clusters": seen["k"], "n_perm": n_perm, "note": None}
    finally:
        rows.unpersist()


def mutual_information(flat: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, mi in nats from the sparse table of two discrete columns."""
    cells = flat.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).cast("double").alias("o"))
    cells = cells.withColumn("r", F.sum("o").over(Window.partitionBy(*by, x))).withColumn("c", F.sum("o").over(Window.partitionBy(*by, y))).withColumn("n", F.sum("o").over(Window.partitionBy(*by)))
    return cells.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("r") * F.col("c"))))).alias("mi"))


def neighbour_information(flat: DataFrame, by: Sequence[str], x: str, y: str, k: int = 3) -> dict[tuple, float]:
    """Ross's estimate of the information between a continuous x and a discrete y, for each by: the distance to the k-th neighbour of the
    same class, and how many of any class lie within it. Neighbours in one dimension are neighbours in order, so windows over the
    distinct values of a class find them (a factor has few: one per cluster). All of by share one plan; those with fewer than
    three rows, or one class, are left out."""
    by = list(by)
    rows = flat.select(*by, finite(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    hist = rows.groupBy(*by, "y", "x").agg(F.count(F.lit(1)).alias("t"))
    total = hist.groupBy(*by, "y").agg(F.sum("t").alias("m"))
    enough = total.groupBy(*by).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("classes")).where("n >= 3 and classes >= 2").select(*by)
    hist = hist.join(total, [*by, "y"]).join(enough, by).persist()
    order = Window.partitionBy(*by, "y").orderBy("x")
    near = []
    for i in range(1, k + 1):
        for move in (F.lag, F.lead):
            near.append(F.when(move("x", i).over(order).isNotNull(), F.struct(F.abs(F.col("x") - move("x", i).over(order)).alias("d"), move("t", i).over(order).alias("c"))))
    r = hist.where("m > 1").withColumn("need", F.least(F.lit(k), F.col("m") - 1)).withColumn("near", F.sort_array(F.array_compact(F.array(*near))))
    walk = "aggregate(near, named_struct('c', t - 1, 'd', 0D), (a, e) -> CASE WHEN a.c >= need THEN a ELSE named_struct('c', a.c + e.c, 'd', e.d) END, a -> a.d)"
    r = r.withColumn("r", F.expr(walk)).withColumn("k", F.when(F.col("r") == 0, F.col("t") - 1).otherwise(F.col("need")))
    # neighbours on the edge don't count as within, ties do
    inner = F.col("r") * (1 - 1e-9)
    edges = r.select(*by, "t", "m", "k", (F.col("x") - inner).alias("lo"), (F.col("x") + inner).alias("hi"))
    marks = hist.select(*by, "x", "t").unionByName(edges.select(*by, F.explode(F.array("lo", "hi")).alias("x"), F.lit(0).cast("long").alias("t")))
    cum = prefix.running(marks.groupBy(*by, "x").agg(F.sum("t").alias("t")), by, "x", ["t"]).persist()
    below, upto = cum.select(*by, F.col("x").alias("lo"), F.col("t__before").alias("below")), cum.select(*by, F.col("x").alias("hi"), (F.col("t__before") + F.col("t")).alias("upto"))
    counts = edges.join(below, [*by, "lo"]).join(upto, [*by, "hi"])
    # digamma of small integers many times over: count them first
    small = counts.select(*by, (F.col("upto") - F.col("below")).alias("c"), "k", "m", "t").groupBy(*by, "c", "k", "m").agg(F.sum("t").alias("n"))
    try:
        small = small.collect()
    finally:
        cum.unpersist()
        hist.unpersist()
    n: dict[tuple, int] = {}
    sums: dict[tuple, float] = {}
    for s in small:
        one = tuple(s[c] for c in by)
        n[one] = n.get(one, 0) + s["n"]
        sums[one] = sums.get(one, 0.0) + s["n"] * (special.digamma(s["k"]) - special.digamma(s["m"]) - special.digamma(max(s["c"], 1)))
    return {one: max(0.0, special.digamma(n[one]) + sums[one] / n[one]) for one in n}
