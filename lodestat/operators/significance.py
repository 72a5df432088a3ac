"""Factor screening at the level at which each factor varies, and the ranking of factors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jobs, special, stats
from ..schema import ALPHA, DEFAULT, N_PERM, SEED, QualitySchema
from . import quality

TESTS = "level string, role string, factor string, kind string, method string, statistic double, effect_size double, p_value double, n long, n_groups long, note string"


def factor_kind(df: DataFrame, factor: str, roles: QualitySchema = DEFAULT) -> str:
    return "categorical" if factor in roles.categorical else quality.kinds(df).get(factor, "categorical")


def _flat(df: DataFrame, factors: Sequence[str], label: str, kind: str) -> DataFrame:
    rows = quality.long(df, factors, label, kind=kind).withColumnRenamed("column", "factor")
    return rows.where(F.col(label).isin(0, 1) & F.col("value").isNotNull()).withColumn("fails", F.col(label) == 1)


def _row(level: str, role: str, factor: str, kind: str, method: str, statistic=None, effect=None, p=None, n=None, groups=None, note=None) -> tuple:
    return (level, role, factor, kind, method, *(None if v is None else float(v) for v in (statistic, effect, p)), n, groups, note)


def naive_tests(df: DataFrame, factors: Sequence[str], label: str, roles: QualitySchema = DEFAULT) -> list[tuple]:
    """Unit by unit, as if units were independent: Mann-Whitney for numbers, chi-square for categories; all factors of a kind in one job."""
    numeric = [f for f in factors if factor_kind(df, f, roles) == "numeric"]
    categorical = [f for f in factors if f not in numeric]
    rows = []
    if numeric:
        for r in stats.mann_whitney_u(_flat(df, numeric, label, "double"), ["factor"], "fails").collect():
            p = stats.mann_whitney_p(r["u"], r["n_a"], r["n_b"], r["ties"])
            rows.append(_row("unit_naive", "primary", r["factor"], "numeric", "mann_whitney", r["u"], r["rank_biserial"], p, r["n_a"] + r["n_b"], 2, None if p is not None else "a side is empty or all values are equal"))
    if categorical:
        for r in stats.chi_square(_flat(df, categorical, label, "string"), ["factor"], "value", label).collect():
            p = special.chi2_sf(r["chi2"], r["dof"]) if r["chi2"] is not None else None
            rows.append(_row("unit_naive", "primary", r["factor"], "categorical", "chi_square", r["chi2"], r["cramers_v"], p, r["n"], r["n_rows"], None if p is not None else "fewer than 2 levels or classes"))
    return rows


def supplementary_tests(df: DataFrame, factors: Sequence[str], label: str, roles: QualitySchema = DEFAULT) -> list[tuple]:
    """Point-biserial correlation of numeric factors; out of the error-rate control."""
    numeric = [f for f in factors if factor_kind(df, f, roles) == "numeric"]
    if not numeric:
        return []
    got = _flat(df, numeric, label, "double").groupBy("factor").agg(F.count(F.lit(1)).alias("n"), stats.correlation(F.col("value"), F.col(label).cast("double")).alias("r"))
    return [_row("unit_naive", "supplementary", r["factor"], "numeric", "point_biserial", r["r"], r["r"], stats.correlation_p(r["r"], r["n"]), r["n"]) for r in got.collect()]


def cluster_tests(df: DataFrame, factors: Sequence[str], label: str, cluster: Callable[[str], str], n_perm: int = N_PERM, seed: int = SEED, roles: QualitySchema = DEFAULT, effects: dict[str, float] | None = None) -> list[tuple]:
    """Permutations of the factor between the clusters in which it is constant; each factor has its own seed."""
    columns = {*df.columns}

    def one(at: tuple[int, str]) -> tuple:
        i, f = at
        kind, key = factor_kind(df, f, roles), cluster(f)
        if key not in columns:
            return _row("unit_cluster", "primary", f, kind, "unavailable", note=f"no {key}")
        got = stats.cluster_permutation(df, key, f, label, n_perm, seed + i, kind)
        return _row("unit_cluster", "primary", f, kind, "cluster_permutation", got["statistic"], (effects or {}).get(f), got["p_value"], got["n_clusters"], None, got["note"])

    return jobs.each(one, enumerate(factors))


def level_tests(rollups: dict[str, DataFrame | None], factors: Sequence[str], cluster: Callable[[str], str], kinds: Callable[[str], str], outcome: str = "fail_rate") -> list[tuple]:
    """On rollups at each factor's own level, where rows are independent: Spearman or Kruskal-Wallis against the outcome."""
    rows = []
    for key, df in rollups.items():
        own = [f for f in factors if cluster(f) == key]
        here = [f for f in own if df is not None and f in df.columns]
        rows += [_row("factor_level", "primary", f, kinds(f), "unavailable", note=f"no {key} table") for f in own if f not in here]
        for kind in ("numeric", "categorical"):
            some = [f for f in here if kinds(f) == kind]
            if not some:
                continue
            flat = quality.long(df, some, outcome, kind="double" if kind == "numeric" else "string").withColumnRenamed("column", "factor")
            if kind == "numeric":
                found = {r["factor"]: r for r in stats.spearman(flat, ["factor"], "value", outcome).collect()}
                for f in some:
                    r = found.get(f)
                    rho, n = (r["rho"], r["n"]) if r else (None, 0)
                    rows.append(_row("factor_level", "primary", f, kind, "spearman_vs_fail_rate", rho, rho, stats.correlation_p(rho, n), n))
            else:
                found = {r["factor"]: r for r in stats.kruskal(flat, ["factor"], "value", outcome).collect()}
                for f in some:
                    r = found.get(f)
                    h = r["h"] if r else None
                    rows.append(_row("factor_level", "primary", f, kind, "kruskal_wallis", h, r["effect"] if r else None, special.chi2_sf(h, r["dof"]) if h is not None else None, r["n"] if r else 0, r["n_groups"] if r else 0))
    return rows


def mutual_information_scores(df: DataFrame, factors: Sequence[str], label: str, roles: QualitySchema = DEFAULT) -> dict[str, float | None]:
    categorical = [f for f in factors if factor_kind(df, f, roles) == "categorical"]
    out: dict[str, float | None] = dict.fromkeys(factors)
    if categorical:
        flat = _flat(df, categorical, label, "string")
        out |= {r["factor"]: r["mi"] for r in stats.mutual_information(flat, ["factor"], "value", label).collect()}
    if numeric := [f for f in factors if f not in categorical]:
        out |= {f: v for (f,), v in stats.neighbour_information(_flat(df, numeric, label, "double"), ["factor"], "value", label).items()}
    return out


def screen_factors(unit: DataFrame, run: DataFrame | None = None, batch: DataFrame | None = None, factors: Sequence[str] | None = None, label: str | None = None, alpha: float = ALPHA, seed: int = SEED, n_perm: int = N_PERM, roles: QualitySchema = DEFAULT, information: bool = True) -> DataFrame:
    """One row per level, factor and method; q and significant by Benjamini-Hochberg within a level's primary tests."""
    spark, label = unit.sparkSession, label or roles.label
    factors = [f for f in (factors or roles.factors) if f in unit.columns]
    kind = lambda f: factor_kind(unit, f, roles)
    naive = naive_tests(unit, factors, label, roles)
    effects = {r[2]: r[6] for r in naive}
    rows = naive + supplementary_tests(unit, factors, label, roles) + cluster_tests(unit, factors, label, roles.level, n_perm, seed, roles, effects)
    rows += level_tests({roles.run: run, roles.batch: batch}, factors, roles.level, kind)
    tests = spark.createDataFrame(rows, TESTS)
    primary = stats.benjamini_hochberg(tests.where("role = 'primary'"), "p_value", ["level"], alpha)
    other = tests.where("role <> 'primary'").withColumn("q", F.lit(None).cast("double")).withColumn("rejected", F.lit(False))
    scores = mutual_information_scores(unit, factors, label, roles) if information else dict.fromkeys(factors)
    mi = spark.createDataFrame([(f, s) for f, s in scores.items()], "factor string, mutual_info double")
    return primary.unionByName(other).withColumnRenamed("rejected", "significant").join(F.broadcast(mi), "factor", "left")


def rank_factors(tests: DataFrame) -> DataFrame:
    """One row per factor: each level's statistic, effect, p, q and verdict; rank by the factor level's q, then the size of the unit effect, then the name."""
    levels = {"factor": "factor_level", "cluster": "unit_cluster", "naive": "unit_naive"}
    aggs = []
    for short, level in levels.items():
        mine = (F.col("level") == level) & (F.col("role") == "primary")
        aggs += [F.max(F.when(mine, F.col(c))).alias(f"{short}_{n}") for c, n in (("method", "method"), ("statistic", "statistic"), ("effect_size", "effect"), ("p_value", "p"), ("q", "q"), ("significant", "significant"), ("n", "n"), ("note", "note"))]
    extra = F.col("role") == "supplementary"
    rows = tests.groupBy("factor").agg(F.max("kind").alias("kind"), F.max("mutual_info").alias("mutual_info"), *aggs, F.max(F.when(extra, F.col("statistic"))).alias("point_biserial"), F.max(F.when(extra, F.col("p_value"))).alias("point_biserial_p"))
    sig = {s: F.coalesce(F.col(f"{s}_significant"), F.lit(False)) for s in levels}
    verdict = F.when(sig["factor"] & sig["cluster"], "significant at its own level and between clusters").when(sig["factor"], "significant at its own level").when(sig["cluster"], "significant between clusters only").when(sig["naive"], "pseudo-replication: significant only if units were independent").otherwise("not significant")
    order = Window.orderBy(F.asc_nulls_last("factor_q"), F.desc_nulls_last(F.abs("naive_effect")), "factor")  # one row per factor
    return rows.withColumn("verdict", verdict).withColumn("rank", F.row_number().over(order)).orderBy("rank")


def significant_factors(ranking: DataFrame, level: str = "factor") -> list[str]:
    column = {"factor": "factor_significant", "unit": "cluster_significant", "unit_naive": "naive_significant"}.get(level)
    return [r["factor"] for r in ranking.where(column).orderBy("rank").select("factor").collect()] if column else []


def top_factor_detail(tests: DataFrame, ranking: DataFrame) -> list[dict]:
    """The first-ranked factor's tests at all levels."""
    top = ranking.where("rank = 1").select("factor")
    return [r.asDict() for r in tests.join(F.broadcast(top), "factor", "left_semi").orderBy("level", "role").collect()]


def stability(screen: Callable[[int], DataFrame], seeds: Sequence[int]) -> DataFrame:
    """factor, and in how many seeds' rankings it is significant at each level. screen makes the ranking of a seed."""
    every = None
    for s in seeds:
        one = screen(s).select("factor", *[F.coalesce(F.col(f"{k}_significant"), F.lit(False)).cast("int").alias(k) for k in ("naive", "cluster", "factor")[:2]], F.coalesce(F.col("factor_significant"), F.lit(False)).cast("int").alias("own"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("factor").agg(F.count(F.lit(1)).alias("seeds"), F.sum("naive").alias("naive"), F.sum("cluster").alias("cluster"), F.sum("own").alias("own"))
