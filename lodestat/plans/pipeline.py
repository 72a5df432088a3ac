"""The whole analysis: read, join, check, clean, screen, model, cluster, regress, trend, report."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, integrate, models, quality, series, significance
from ..schema import DEFAULT, N_PERM, SEED, QualitySchema
from ..sources import synth, tables
from . import plotdata, report


def run_timeseries(df: DataFrame, roles: QualitySchema = DEFAULT, values: tuple[str, ...] = (), include_imputed: bool = False) -> dict:
    """Batch and run failure rates and batch means of values; filled-in measurements stay out unless asked for."""
    if roles.batch not in df.columns or roles.label not in df.columns:
        return {"note": "cannot analyze: no batch or label column"}
    if df.select(roles.batch).distinct().limit(2).count() < 2:
        return {"note": "series too short"}
    time_ = roles.time if roles.time in df.columns else None
    points = series.series_of(df, roles.batch, roles.label, time_, "batch_fail_rate")
    if roles.run in df.columns:
        points = points.unionByName(series.series_of(df, roles.run, roles.label, time_, "run_fail_rate"))
    for v in values:
        flag = f"{v}_was_missing"
        rows = df.where(~F.col(flag)) if flag in df.columns and not include_imputed else df
        points = points.unionByName(series.series_of(rows, roles.batch, v, time_, f"batch_{v}"))
    points = points.persist()
    try:
        return series.analyze(points)
    finally:
        points.unpersist()


def run_pipeline(spark: SparkSession, out_dir: str, data_dir: str, seed: int = SEED, regenerate: bool = False, n_perm: int = N_PERM, make_plots: bool = True, roles: QualitySchema = DEFAULT, log: Callable[[str], None] = print, light: bool = False) -> dict:
    """Writes metrics.json, tables as CSV, report.md and run_meta.json. light: fewer trees, rounds and starts, no cross-validation."""
    took, began = {}, time.time()

    def lap(name: str) -> None:
        nonlocal began
        took[name] = time.time() - began
        began = time.time()
        log(f"{name}: {took[name]:.1f} s")

    trees, rounds, starts = (20, 10, 2) if light else (300, 200, 10)
    raw, manifest, generated = synth.ensure_raw_data(spark, data_dir, seed, regenerate)
    lap("read")
    wide = integrate.build_analysis_table(raw, roles).persist()
    checks = quality.run_quality_checks(wide, roles, raw["perf_tests"])
    lap("quality")
    clean, actions = integrate.clean(wide, roles)
    clean = clean.persist()
    runs, batches = integrate.build_run_level_table(clean, roles), integrate.build_batch_level_table(clean, roles)
    lap("clean")
    tests = significance.screen_factors(clean, runs, batches, seed=seed, n_perm=n_perm, roles=roles).persist()
    ranking = significance.rank_factors(tests).persist()
    lap("significance")
    modeling = models.run_modeling(clean, roles, seed, cv=not light, trees=trees, rounds=rounds, repeats=1 if light else 5, frames=(test_rows := {}))
    modeling["ablation"] = models.ablation(clean, modeling["best_model"], roles, seed, trees, rounds)
    lap("classification")
    clusters = cluster.run_clustering(clean, roles, seed, starts=starts)
    lap("clustering")
    regression = models.run_regression(clean, roles, seed, rounds=rounds, frames=(predicted := {}))
    lap("regression")
    trends = run_timeseries(clean, roles, roles.measured[:2])
    lap("series")
    points = clusters.pop("pca", None)
    metrics = {
        "seed": seed, "rows": {name: df.count() for name, df in raw.items()} | {"wide": checks["n_rows"], "clean": actions["rows_final"]}, "ground_truth": manifest.get("ground_truth_mechanism"),
        "quality_summary": quality.summarize_quality(checks), "quality": checks, "cleaning": actions, "ranking": [r.asDict() for r in ranking.orderBy("rank").collect()],
        "significant_factors": significance.significant_factors(ranking), "top_factor": significance.top_factor_detail(tests, ranking), "modeling": modeling, "clustering": clusters, "regression": regression, "series": trends,
    }
    tables.write_json(metrics, f"{out_dir}/metrics.json", spark)
    frames = {"factor_ranking": ranking, "significance_tests": tests}
    if "profile" in clusters and clusters["profile"]:
        frames["cluster_profile"] = spark.createDataFrame(clusters["profile"])
    if points is not None:
        frames["cluster_points"] = points
    frames["model_comparison"] = spark.createDataFrame([(n, r["threshold"]["threshold"], r["test"]["average_precision"], r["test"]["roc_auc"], r["test"]["f1"]) for n, r in modeling["models"].items()], "model string, threshold double, average_precision double, roc_auc double, f1 double")
    if make_plots:
        drawn = plotdata.catalog(clean, runs, roles, ranking) | plotdata.model_catalog(modeling, test_rows, roles)
        if roles.measured:
            drawn |= plotdata.regression_catalog(predicted, roles.measured[0])
        if roles.batch in clean.columns:
            drawn["series_trend"] = plotdata.series_trend(series.series_of(clean, roles.batch, roles.label, roles.time if roles.time in clean.columns else None, "batch_fail_rate"))
        if clusters.get("k_selection"):
            drawn["cluster_selection"] = spark.createDataFrame(clusters["k_selection"])
        frames |= {f"plot_{k}": v for k, v in drawn.items()}
    for name, df in frames.items():
        tables.write_csv(df.coalesce(1), f"{out_dir}/{name}.csv")
    tables.write_text(report.markdown(metrics), f"{out_dir}/report.md", spark)
    lap("report")
    report.write_run_meta(f"{out_dir}/run_meta.json", took, seed, spark, generated=generated)
    for df in (wide, clean, tests, ranking):
        df.unpersist()
    return metrics
