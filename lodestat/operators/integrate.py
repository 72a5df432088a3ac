"""Joining sources of different grain without fan-out, rollups, and the cleaning recipe."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prefix
from ..schema import DEFAULT, QualitySchema


class CardinalityError(ValueError):
    """The right side of a many-to-one join has a key twice."""


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, if no non-null key comes twice; one aggregate, and of the offenders one row only comes back."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise CardinalityError(f"{key} {twice[0][0]!r} comes {twice[0]['count']} times")
    return df


def many_to_one(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Left join that can't add rows. The optimizer picks broadcast or shuffle by the sides' sizes."""
    return left.join(require_unique(right, key) if check else right, key, "left")


def aggregate_child(child: DataFrame, key: str, values: Iterable[str], count: str) -> DataFrame:
    """One row per non-null key: means of the values present (nulls skipped) and the number of rows (nulls counted)."""
    present = [v for v in values if v in child.columns]
    return child.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(v).alias(v) for v in present], F.count(F.lit(1)).alias(count))


def build_analysis_table(tables: dict[str, DataFrame], roles: QualitySchema = DEFAULT, check: bool = True) -> DataFrame:
    """Inspections with mean tests per unit, run conditions and batch properties; as many rows as inspections."""
    units, runs = tables["inspection_results"], tables["production_runs"]
    perf = aggregate_child(tables["perf_tests"], roles.unit, roles.measured, "perf_test_count")
    wide = many_to_one(units.drop("shift"), perf, roles.unit, check=False)  # unique by construction
    wide = many_to_one(wide, runs.drop(roles.batch), roles.run, check)
    return many_to_one(wide, tables["material_batches"], roles.batch, check)


def rollup(df: DataFrame, key: str, label: str, factors: Iterable[str], inner: str | None = None, inner_name: str = "n_runs", order: str | None = None) -> DataFrame:
    """Per key: fail_rate, n_units, n_fail, each factor's first non-null value (by order, else the least), and the distinct inner keys."""
    first = [(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))) if order else F.min(c)).alias(c) for c in factors if c in df.columns]
    nested = [F.countDistinct(inner).alias(inner_name)] if inner else []
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("fail_rate"), F.count(F.lit(1)).alias("n_units"), F.sum(label).alias("n_fail"), *nested, *first)


def build_run_level_table(wide: DataFrame, roles: QualitySchema = DEFAULT) -> DataFrame:
    return rollup(wide, roles.run, roles.label, [*roles.factors, roles.batch])


def build_batch_level_table(wide: DataFrame, roles: QualitySchema = DEFAULT) -> DataFrame:
    return rollup(wide, roles.batch, roles.label, roles.batch_numeric + roles.batch_categorical, roles.run)


def clean(wide: DataFrame, roles: QualitySchema = DEFAULT, limits: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, dict]:
    """The recipe, in order: exact duplicates go; values out of limits become null; measured columns get *_was_missing;
    nulls of numerics get the median of what is left; null categories become UNKNOWN; rows without a label go.

    All counts and medians come from one pass: deduplicated rows with how often each came, counted by (what, value).
    Medians are read off running sums of those counts, so no task holds a column's values.
    """
    limits = roles.limits if limits is None else limits
    bounded = {c: b for c, b in limits.items() if c in wide.columns}
    outside = {c: (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in bounded.items()}
    within = {c: F.when(~o, F.col(c)) for c, o in outside.items()}
    numeric = [c for c in roles.numeric + roles.measured if c in wide.columns]
    categorical = [c for c in roles.categorical if c in wide.columns]
    nulled = wide.dropDuplicates().withColumns(within)
    flags = {f"{c}_was_missing": F.col(c).isNull() for c in roles.measured if c in wide.columns}
    facts = {("rows", ""): F.col("__times"), ("unlabelled", ""): F.col(roles.label).isNull()}
    facts |= {("outside", c): F.coalesce(o, F.lit(False)) for c, o in outside.items()} | {("no category", c): F.col(c).isNull() for c in categorical}
    facts |= {("value", c): within.get(c, F.col(c)) for c in numeric}
    told = F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.lit(c).alias("column"), v.cast("double").alias("value")) for (w, c), v in facts.items()]))
    hist = wide.groupBy(*wide.columns).agg(F.count(F.lit(1)).alias("__times")).select(told.alias("f")).groupBy("f.what", "f.column", "f.value").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        sums = {(r["what"], r["column"]): r for r in hist.groupBy("what", "column").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("what") != "value", F.col("value") * F.col("n"))), F.lit(0.0)).cast("long").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls")).where("what <> 'value' or nulls > 0").collect()}
        lacking = [c for c in numeric if ("value", c) in sums]
        counted = hist.where((F.col("what") == "value") & F.col("column").isin(lacking) & F.col("value").isNotNull())
        medians = {r["column"]: r["q"][0] for r in prefix.quantiles(prefix.running(counted, ["column"], "value", ["n"]), ["column"], "value", "n", [0.5]).collect()} if lacking else {}
    finally:
        hist.unpersist()
    total = lambda what, c="": sums[what, c]["total"] if (what, c) in sums else 0
    n, before = (sums["rows", ""]["n"], total("rows")) if sums else (0, 0)
    filled = {c: medians[c] for c in numeric if medians.get(c) is not None}
    unknown = [c for c in categorical if total("no category", c)]
    out = nulled.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in filled.items()})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in unknown}).where(F.col(roles.label).isNotNull())
    return out, {
        "exact_duplicate_rows_dropped": before - n, "rows_before": before, "rows_after_dedup": n,
        "out_of_range_to_nan": {c: total("outside", c) for c in outside if total("outside", c)}, "numeric_median_imputed": filled, "categorical_filled_unknown": unknown,
        "missing_indicator_columns": sorted(flags), "rows_dropped_missing_label": total("unlabelled"), "rows_final": n - total("unlabelled"),
    }
