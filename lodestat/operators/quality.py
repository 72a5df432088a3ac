"""Data-quality checks: what is missing, out of range, repeated, constant, mistyped, drifted or unbalanced."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prefix, special
from ..schema import BASELINE_SHARE, DEFAULT, DRIFT_BINS, DRIFT_KS_ALPHA, DRIFT_KS_STATISTIC, DRIFT_PSI, DRIFT_WATCH, NEAR_CONSTANT, QualitySchema


def long(df: DataFrame, columns: Iterable[str], *keep: str, kind: str = "double") -> DataFrame:
    """(column, value, keep...): all columns in one pass, so that one grouped plan serves them all."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns]))
    return df.select(*keep, pairs.alias("p")).select("p.column", "p.value", *keep)


def missing_by_column(df: DataFrame) -> DataFrame:
    """column, n_missing, n_rows, pct, all_missing; one aggregate, then one small row per column."""
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(df.columns)]))
    out = got.select("n", rows.alias("r")).select("r.column", "r.n_missing", F.col("n").alias("n_rows"))
    return out.withColumn("pct", F.when(F.col("n_rows") > 0, 100.0 * F.col("n_missing") / F.col("n_rows")).otherwise(0.0)).withColumn("all_missing", (F.col("n_rows") > 0) & (F.col("n_missing") == F.col("n_rows"))).orderBy(F.desc("n_missing"), "column")


def missing_by_row(df: DataFrame) -> DataFrame:
    """n_missing, n_rows: how many rows lack so many values."""
    lacking = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
    return df.select(lacking.alias("n_missing")).groupBy("n_missing").agg(F.count(F.lit(1)).alias("n_rows"))


def out_of_range(df: DataFrame, limits: dict[str, tuple[float, float]], key: str) -> DataFrame:
    """column, lower, upper, n_below, n_above, n_out_of_range, pct, first_example (by key) and the value farthest outside."""
    rows = [F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper"), F.col(c).cast("double").alias("value")) for c, (lo, hi) in limits.items() if c in df.columns]
    flat = df.select(F.col(key).alias("key"), F.explode(F.array(*rows)).alias("r")).select("key", "r.*")
    below, above = F.col("value") < F.col("lower"), F.col("value") > F.col("upper")
    excess = F.greatest(F.col("lower") - F.col("value"), F.col("value") - F.col("upper"))
    out = flat.groupBy("column", "lower", "upper").agg(
        F.count_if(below).alias("n_below"), F.count_if(above).alias("n_above"), F.count_if(below | above).alias("n_out_of_range"), F.count(F.lit(1)).alias("n_rows"),
        F.min(F.when(below | above, F.struct("key", "value"))).alias("f"), F.max(F.when(below | above, F.struct(excess.alias("x"), "value"))).alias("w"),
    )
    return out.select("column", "lower", "upper", "n_below", "n_above", "n_out_of_range", (100.0 * F.col("n_out_of_range") / F.col("n_rows")).alias("pct"), F.col("f.value").alias("first_example"), F.col("w.value").alias("worst_example"))


def duplicates(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """what (full row or a key), n_rows, n_unique, n_beyond_first, is_unique. Nulls are no keys."""
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.lit("(row)").alias("what"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))
    present = [k for k in keys if k in df.columns]
    out = full
    if present:
        by_key = long(df, present, kind="string").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        out = full.unionByName(by_key.groupBy(F.col("column").alias("what")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique")))
    return out.withColumn("n_beyond_first", F.col("n_rows") - F.col("n_unique")).withColumn("is_unique", F.col("n_beyond_first") == 0)


def fanout(child: DataFrame, key: str) -> DataFrame:
    """n_children, n_parents: how many parents have so many rows. Its largest key is what a naive join multiplies by."""
    return child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_children")).groupBy("n_children").agg(F.count(F.lit(1)).alias("n_parents"))


def fanout_summary(child: DataFrame, key: str) -> dict:
    if key not in child.columns:
        return {"present": False}
    got = {r["n_children"]: r["n_parents"] for r in fanout(child, key).collect()}
    rows, parents = sum(a * b for a, b in got.items()), sum(got.values())
    return {"present": True, "n_child_rows": rows, "n_distinct": parents, "max": max(got, default=0), "mean": round(rows / parents, 4) if parents else None, "rows_if_naively_merged": rows, "distribution": dict(sorted(got.items())), "fanout_detected": max(got, default=0) > 1}


def constant_columns(df: DataFrame, share: float = NEAR_CONSTANT) -> DataFrame:
    """column, n_valid, n_unique, top_value, top_share, is_constant, is_near_constant; ties go to the least value."""
    counts = long(df, df.columns, kind="string").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("column").agg(F.sum("n").alias("n_valid"), F.count(F.lit(1)).alias("n_unique"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    out = names.join(F.broadcast(found), "column", "left").select("column", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"), F.col("top.value").alias("top_value"), (-F.col("top.n") / F.col("n_valid")).alias("top_share"))
    return out.withColumn("is_constant", F.col("n_unique") <= 1).withColumn("is_near_constant", (F.col("n_unique") > 1) & (F.col("top_share") >= share))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """n, n_pos, n_neg, positive_rate, neg_pos_ratio, minority_share, severity."""
    got = df.agg(F.count(label).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    minority = F.least("n_pos", "n_neg") / F.nullif(F.col("n"), F.lit(0))
    severity = F.when(F.col("n") == 0, "empty").when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), "degenerate").when(minority < 0.05, "severe").when(minority < 0.20, "moderate").otherwise("balanced")
    return got.select("n", "n_pos", "n_neg", (F.col("n_pos") / F.nullif(F.col("n"), F.lit(0))).alias("positive_rate"), (F.col("n_neg") / F.nullif(F.col("n_pos"), F.lit(0))).alias("neg_pos_ratio"), minority.alias("minority_share"), severity.alias("severity"))


def dtype_issues(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column, n_unparsable, the first example and the first three different ones, of values that are no numbers; Java's own number suffixes are none either."""
    flat = long(df, [c for c in columns if c in df.columns], kind="string")
    number = F.col("value").try_cast("double").isNotNull() & ~F.col("value").rlike("[dDfF]$")
    bad = flat.where(F.col("value").isNotNull() & ~F.coalesce(number, F.lit(False)))
    counts = bad.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    first = counts.withColumn("i", place).where("i <= 3").groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("examples"))
    total = counts.groupBy("column").agg(F.sum("n").alias("n_unparsable"), F.min("value").alias("example"))
    return total.join(first, "column").select("column", "n_unparsable", "example", "examples")


def baseline_keys(df: DataFrame, key: str, time: str, share: float = BASELINE_SHARE) -> DataFrame:
    """key, start, is_baseline: the earliest share of the keys (at least one; half to even) by first time, then key."""
    runs = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(time).alias("start"))
    n = runs.count()
    least = max(1, round(n * share))
    place = F.struct(F.col("start").isNull().alias("n"), F.col("start").alias("s"), F.col(key).alias("k"))  # by the time's own type, those without last
    edge = runs.orderBy(F.asc_nulls_last("start"), key).limit(least).agg(F.max(place).alias("e"))
    return runs.crossJoin(F.broadcast(edge)).select(key, "start", (place <= F.col("e")).alias("is_baseline"))


def baseline(df: DataFrame, roles: QualitySchema = DEFAULT, batch: str | None = None) -> tuple[DataFrame, dict]:
    """df with is_baseline, and how it was chosen: the rows of the batch given, else the earliest runs, else, without times, the first batches by name.

    All rows stay; those without a key are not of the baseline.
    """
    columns = {*df.columns}
    if batch is not None and roles.batch in columns:
        return df.withColumn("is_baseline", F.coalesce(F.col(roles.batch) == batch, F.lit(False))), {"method": "batch", "batch": batch}
    if {roles.run, roles.time} <= columns:
        key, time, method = roles.run, roles.time, "earliest runs"
    elif roles.batch in columns:
        key, time, method = roles.batch, roles.batch, "first batches by name"
    else:
        return df.withColumn("is_baseline", F.lit(False)), {"method": None, "note": "no run, time or batch column"}
    keys = baseline_keys(df, key, time).select(F.col(key).alias("__key"), "is_baseline").cache()
    n = keys.agg(F.count_if("is_baseline").alias("b"), F.count(F.lit(1)).alias("n")).first()
    marked = df.join(keys, df[key] == F.col("__key"), "left").drop("__key").withColumn("is_baseline", F.coalesce("is_baseline", F.lit(False)))
    return marked, {"method": method, "key": key, "n_baseline": n["b"], "n_keys": n["n"]}


def histogram(flat: DataFrame, side: str) -> DataFrame:
    """(column, value) with the rows on either side of the boolean side; no nulls and no NaN."""
    return flat.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("column", "value").agg(F.count_if(F.col(side)).alias("n1"), F.count_if(~F.col(side)).alias("n2"))


@contextlib.contextmanager
def counted(flat: DataFrame, side: str) -> Iterator[DataFrame]:
    """The histogram with its running counts, kept while measures are taken from it, so that the rows are read and shuffled once."""
    hist = histogram(flat, side).persist()
    run = prefix.running(hist, ["column"], "value", ["n1", "n2"]).persist()
    try:
        yield run
    finally:
        run.unpersist()
        hist.unpersist()


def _taken(df: DataFrame) -> DataFrame:
    """df, a row per column, worked out now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ks_statistic(flat: DataFrame, side: str) -> DataFrame:
    """column, n1, n2, ks: the largest gap of the two distribution functions, over distinct finite values."""
    with counted(flat, side) as run:
        return _taken(_ks(run))


def _ks(run: DataFrame) -> DataFrame:
    below, finite = F.col("value") == float("-inf"), F.abs("value") != float("inf")
    totals = run.groupBy("column").agg(*[F.sum(F.when(f, F.col(n))).alias(t) for n, t, f in (("n1", "t1", finite), ("n2", "t2", finite))], *[F.coalesce(F.sum(F.when(below, F.col(n))), F.lit(0)).alias(m) for n, m in (("n1", "m1"), ("n2", "m2"))])
    share = lambda i: (F.col(f"n{i}__before") + F.col(f"n{i}") - F.col(f"m{i}")) / F.nullif(F.col(f"t{i}"), F.lit(0))
    return run.where(finite).join(F.broadcast(totals), "column").groupBy("column").agg(F.max("t1").alias("n1"), F.max("t2").alias("n2"), F.max(F.abs(share(1) - share(2))).alias("ks"))


def psi(flat: DataFrame, side: str, bins: int = DRIFT_BINS) -> DataFrame:
    """column, psi: shift of the current rows against the baseline's quantile bins; null under 3 edges, 2 baseline or 1 current values."""
    with counted(flat, side) as run:
        return _taken(_psi(run, bins))


def _psi(run: DataFrame, bins: int) -> DataFrame:
    edges = prefix.quantiles(run, ["column"], "value", "n1", [i / bins for i in range(bins + 1)]).withColumnRenamed("total", "t1")
    edges = edges.withColumn("q", F.array_distinct(F.coalesce("q", F.array().cast("array<double>")))).withColumn("inner", F.expr("slice(q, 2, greatest(size(q) - 2, 0))"))
    counts = prefix.ranged(run, edges, ["column"], "value", "inner", "bin", closed="left").groupBy("column", "bin").agg(F.sum("n1").alias("c1"), F.sum("n2").alias("c2"))
    every = edges.select("column", "t1", F.size("q").alias("m"), F.explode(F.expr("sequence(0, greatest(size(inner), 0))")).alias("bin"))
    full = every.join(counts, ["column", "bin"], "left").withColumn("t2", F.sum("c2").over(Window.partitionBy("column")))
    share = lambda c, t: F.greatest(F.lit(1e-6), F.coalesce(F.col(c), F.lit(0)) / F.nullif(F.col(t), F.lit(0)))
    b, c = share("c1", "t1"), share("c2", "t2")
    good = (F.col("t1") >= 2) & (F.col("t2") >= 1) & (F.col("m") >= 3)
    return full.groupBy("column").agg(F.sum(F.when(good, (c - b) * F.log(c / b))).alias("psi"))


def severity(psi_: Column, ks: Column) -> Column:
    return F.when(psi_.isNull(), "undeterminable").when((psi_ >= DRIFT_PSI) & (ks >= DRIFT_KS_STATISTIC), "significant").when(psi_ >= DRIFT_WATCH, "watch").otherwise("stable")


def drift(df: DataFrame, columns: Iterable[str], side: str) -> DataFrame:
    """column, n1, n2, means, mean_shift_pct, ks, psi, severity. side marks the baseline rows."""
    flat = long(df, [c for c in columns if c in df.columns], side)
    mean = lambda n: F.try_divide(F.sum(F.when(F.col(n) > 0, F.col("value") * F.col(n))), F.sum(n))
    with counted(flat, side) as run:
        means = run.groupBy("column").agg(mean("n1").alias("baseline_mean"), mean("n2").alias("current_mean"))
        out = _ks(run).where("n1 >= 2 and n2 >= 2").join(_psi(run, DRIFT_BINS), "column").join(means, "column")
        shift = F.try_divide(F.col("current_mean") - F.col("baseline_mean"), F.abs("baseline_mean")) * 100
        return _taken(out.select("column", "n1", "n2", "baseline_mean", "current_mean", shift.alias("mean_shift_pct"), "ks", "psi", severity(F.col("psi"), F.col("ks")).alias("severity")))


def drift_report(df: DataFrame, columns: Iterable[str], side: str, alpha: float = DRIFT_KS_ALPHA) -> list[dict]:
    """drift() with the KS p-value (asymptotic) and the triple gate; one row per column comes to the driver."""
    rows = []
    for r in drift(df, columns, side).collect():
        p = special.ks_p(r["ks"], r["n1"], r["n2"])
        gate = p is not None and p < alpha and r["ks"] >= DRIFT_KS_STATISTIC and r["psi"] is not None and r["psi"] >= DRIFT_PSI
        note = "large samples make small shifts significant; drifted asks for effect size too" if p is not None and p < alpha and not gate else ""
        rows.append(r.asDict() | {"ks_p_value": p, "ks_method": "asymptotic", "ks_significant": p is not None and p < alpha, "drifted": gate, "note": note})
    return sorted(rows, key=lambda r: (not r["drifted"], -(r["psi"] if r["psi"] is not None else -1), r["column"]))


def run_quality_checks(wide: DataFrame, roles: QualitySchema = DEFAULT, perf: DataFrame | None = None, key: str | None = None, baseline_batch: str | None = None) -> dict:
    """All checks over one frame, each a small result on the driver."""
    table = lambda df: [r.asDict() for r in df.collect()]
    marked, info = baseline(wide, roles, baseline_batch)
    return {
        "n_rows": wide.count(), "n_columns": len(wide.columns), "missing_by_column": table(missing_by_column(wide)), "missing_by_row": {r["n_missing"]: r["n_rows"] for r in missing_by_row(wide).collect()},
        "out_of_range": table(out_of_range(wide, roles.limits, key or roles.unit)), "duplicates": table(duplicates(wide, (roles.batch, roles.run, roles.unit))),
        "perf_fanout": fanout_summary(perf, roles.unit) if perf is not None else None, "constant_columns": table(constant_columns(wide)),
        "drift": drift_report(marked, [c for c in roles.numeric + roles.measured if c in wide.columns], "is_baseline"), "baseline_info": info,
        "class_balance": table(class_balance(wide, roles.label))[0] if roles.label in wide.columns else {"present": False},
        "dtype_issues": table(dtype_issues(wide, roles.numeric + roles.measured)),
    }


def summarize_quality(report: dict) -> dict:
    rows = {k: v for k, v in report["missing_by_row"].items() if k}
    return {
        "n_rows": report["n_rows"], "columns_with_missing": sum(r["n_missing"] > 0 for r in report["missing_by_column"]), "rows_with_missing": sum(rows.values()), "max_missing_per_row": max(rows, default=0),
        "out_of_range_values": sum(r["n_out_of_range"] for r in report["out_of_range"]), "full_duplicate_rows": next(r["n_beyond_first"] for r in report["duplicates"] if r["what"] == "(row)"),
        "constant_columns": sorted(r["column"] for r in report["constant_columns"] if r["is_constant"]), "near_constant_columns": sorted(r["column"] for r in report["constant_columns"] if r["is_near_constant"]),
        "drifted_columns": sorted(r["column"] for r in report["drift"] if r["drifted"]), "class_balance": report["class_balance"].get("severity"),
    }


def kinds(df: DataFrame) -> dict[str, str]:
    """numeric or categorical, by type."""
    return {f.name: "numeric" if isinstance(f.dataType, T.NumericType) else "categorical" for f in df.schema}

