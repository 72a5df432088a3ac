"""Checks of the whole: do two runs give the same, and does the made-up factory show what was put into it?"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrate, quality, significance
from ..schema import DEFAULT, SEED
from ..sources import synth, tables
from . import pipeline

#: What must be the same from run to run; run_meta.json, with its times, must not.
JSON, TEXT, CSV = "metrics.json", "report.md", ("factor_ranking", "significance_tests", "model_comparison")


def reproducibility(spark: SparkSession, out_dir: str, n_perm: int = 200, light: bool = False, log: Callable[[str], None] = lambda _: None) -> dict:
    """Two runs, the second on the tables that the first wrote. files: name -> whether both are the same; tables by their rows in any order."""
    for i in (1, 2):
        pipeline.run_pipeline(spark, f"{out_dir}/run{i}", f"{out_dir}/data", regenerate=i == 1, n_perm=n_perm, make_plots=False, log=log, light=light)
    both = lambda read: read(f"{out_dir}/run1") == read(f"{out_dir}/run2")
    text = lambda name: lambda d: spark.read.text(f"{d}/{name}", wholetext=True).first()[0]
    rows = lambda name: lambda d: tables.fingerprint(spark.read.option("header", True).csv(f"{d}/{name}.csv"))
    files = {name: both(text(name)) for name in (JSON, TEXT)} | {f"{name}.csv": both(rows(name)) for name in CSV}
    return {"files": files, "same": all(files.values()), "run_meta_differs": not both(text("run_meta.json"))}


def calibration(spark: SparkSession, seeds: Sequence[int], n_perm: int, ranking_of: Callable[[SparkSession, int, int], DataFrame]) -> dict:
    """In how many seeds each factor is found at each level, by the part it plays; and size, failure rate, readings and limits passed of the first seed."""
    group = {f: g for g, own in synth.ground_truth().items() for f in own}
    found = significance.stability(lambda s: ranking_of(spark, s, n_perm), seeds)
    factors = sorted(({"group": group.get(r["factor"], "other")} | r.asDict() for r in found.collect()), key=lambda r: (r["group"], r["factor"]))
    raw, _ = synth.generate_all(spark, seeds[0] if seeds else SEED)
    units, perf = raw["inspection_results"], raw["perf_tests"]
    size = units.agg(F.count(F.lit(1)).alias("units"), F.sum("is_fail").alias("fails"), F.avg("is_fail").alias("fail_rate")).first().asDict()
    kinds = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    got = perf.agg(*[f(c).alias(f"{c}:{k}") for c in DEFAULT.measured for k, f in kinds]).first()
    readings = {c: {k: got[f"{c}:{k}"] for k, _ in kinds} for c in DEFAULT.measured}
    beyond = quality.out_of_range(integrate.build_analysis_table(raw), DEFAULT.limits, DEFAULT.unit).where("n_out_of_range > 0")
    return {"seeds": list(seeds), "factors": factors, "size": size | {"runs": raw["production_runs"].count(), "perf_rows": perf.count()}, "readings": readings, "out_of_range": [r.asDict() for r in beyond.collect()]}
