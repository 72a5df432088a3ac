"""The data behind the figures, one small frame each; nothing is drawn here."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prefix, stats
from ..operators import cluster, evaluate, quality, series


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def rate_histogram(runs: DataFrame, column: str = "fail_rate", bins: int = 20) -> DataFrame:
    """bin, n over [0, 1]; 1 falls in the last bin."""
    bin_ = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    return runs.where(F.col(column).between(0, 1)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, columns: Sequence[str], label: str, bins: int = 40) -> DataFrame:
    """Per column and class a histogram over the column's range: column, label, bin, n, density."""
    flat = quality.long(df, columns, label).where("value is not null")
    ends = flat.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    rows = flat.join(F.broadcast(ends), "column").where("hi > lo").withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    counts = rows.groupBy("column", label, "bin").agg(F.count(F.lit(1)).alias("n"), F.first(width).alias("w"))
    totals = rows.groupBy("column", label).agg(F.count(F.lit(1)).alias("t"))
    return counts.join(F.broadcast(totals), ["column", label]).select("column", label, "bin", "n", (F.col("n") / F.col("t") / F.col("w")).alias("density"))


def box_stats(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Per column and class: n, minimum, quartiles and maximum of the column's z-scores."""
    flat = quality.long(df, columns, label).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    all_ = flat.groupBy("column").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    hist = flat.groupBy("column", label, "value").agg(F.count(F.lit(1)).alias("n"))
    got = prefix.quantiles(prefix.running(hist, ["column", label], "value", ["n"]), ["column", label], "value", "n", (0.0, 0.25, 0.5, 0.75, 1.0))
    z = got.join(F.broadcast(all_), "column").where("s > 0")
    return z.select("column", label, F.col("total").alias("n"), *[((F.col("q")[i] - F.col("m")) / F.col("s")).alias(c) for i, c in enumerate(("z_min", "z_q1", "z_median", "z_q3", "z_max"))])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, rho (Spearman over pairwise complete rows), for a < b."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    flat = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return stats.spearman(flat, ["a", "b"], "x", "y").select("a", "b", "rho")


def effects(ranking: DataFrame, top: int = 12) -> DataFrame:
    return ranking.select("factor", F.abs("naive_effect").alias("effect"), "verdict").orderBy(F.desc_nulls_last("effect"), "factor").limit(top)


def curves(df: DataFrame, label: str, score: str) -> DataFrame:
    """Points of the ROC and precision-recall curves at each distinct score."""
    c = evaluate.curve(df, label, score)
    total = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return c.crossJoin(F.broadcast(total)).select("score", (F.col("tp") / F.nullif(F.col("p"), F.lit(0))).alias("recall"), (F.col("fp") / F.nullif(F.col("n"), F.lit(0))).alias("false_positive_rate"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def predicted_vs_actual(df: DataFrame, y: str, predicted: str, bins: int = 50) -> DataFrame:
    """A grid of counts in place of a scatter of all rows."""
    ends = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    at = lambda c: F.floor((F.col(c) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins).cast("int")
    return df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at(y).alias("actual_bin"), at(predicted).alias("predicted_bin")).agg(F.count(F.lit(1)).alias("n"))


def series_trend(points: DataFrame, window: int = 5) -> DataFrame:
    return series.moving_average(points, window).join(series.backtest_points(points).drop("value", "last", "mean"), ["series", "pos"], "left")


def catalog(clean: DataFrame, runs: DataFrame, roles, ranking: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames for the figures that need no model."""
    numeric = [c for c in roles.numeric if c in clean.columns]
    out = {
        "label_counts": label_counts(clean, roles.label), "run_rates": rate_histogram(runs), "density": density(clean, numeric[:6], roles.label), "boxes": box_stats(clean, numeric, roles.label),
        "correlation": correlation_matrix(clean.withColumn(roles.label, F.col(roles.label).cast("double")), [*numeric, roles.label]), "missing": quality.missing_by_column(clean), "out_of_range": quality.out_of_range(clean, roles.limits, roles.unit),
    }
    if roles.defect in clean.columns:
        out["defects"] = cluster.composition(clean.where(F.col(roles.label) == 1), roles.batch, roles.defect)
    if ranking is not None:
        out["effects"] = effects(ranking)
    return out


def model_catalog(modeling: dict, scored: dict[str, DataFrame], roles) -> dict[str, DataFrame]:
    """ROC and precision-recall points of every model, and the best one's confusion matrix at its threshold."""
    out, best = {}, modeling["best_model"]
    lines = [curves(df, roles.label, "score").withColumn("model", F.lit(name)) for name, df in scored.items()]
    if lines:
        out["model_curves"] = functools.reduce(DataFrame.unionByName, lines)
        hit = F.col("score") >= modeling["models"][best]["threshold"]["threshold"]
        out["confusion"] = evaluate.confusion(scored[best], roles.label, hit).select(F.lit(best).alias("model"), "tn", "fp", "fn", "tp")
    return out


def regression_catalog(predicted: dict[str, DataFrame], target: str) -> dict[str, DataFrame]:
    """A grid of actual and predicted values for each model of one target."""
    return {f"actual_{name}": predicted_vs_actual(df, target, "prediction") for name, df in predicted.items() if name.startswith(f"{target}_")}
