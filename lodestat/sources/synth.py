"""A made-up factory: four tables with known causes of failure and known defects of the data.

Every draw is a hash of (seed, purpose, key), never rand(): the tables are the
same whatever the partitioning. ground_truth() names the causes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SEED, TABLES
from . import tables

BATCHES, RUNS_PER_BATCH, LEAST_UNITS, MOST_UNITS, TESTED, TEST_MISSING = 36, 4, 30, 40, 0.70, 0.06

#: The causes. Weights are on the logit of failure per standard deviation or per level.
BASE_LOGIT, RUN_NOISE, UNIT_NOISE = -3.95, 0.20, 0.28
OVERHEAT, UNDERHEAT, BEST_TEMP, TEMP_SD = 1.55, 0.70, 1505.0, 8.5
LINEAR = {"material_moisture_pct": (1.35, 3.43, 0.45), "pressure_mpa": (1.05, 3.00, 0.26), "line_speed_mpm": (0.35, 21.0, 4.20), "cooling_rate_cps": (-0.40, 8.0, 1.38), "ambient_humidity_pct": (0.0, 48.0, 12.0)}
MACHINES = {"M1": (0.28, 0.00), "M2": (0.26, 0.15), "M3": (0.24, 1.75), "M4": (0.22, 0.05)}
SHIFTS = {"A": 0.00, "B": 0.20, "C": 0.70}
SUPPLIERS = {"SUP-A": (0.45, 0.00), "SUP-B": (0.35, 0.26), "SUP-C": (0.20, 0.58)}
METHODS = {"visual": 0.6, "xray": 0.28, "ultrasonic": 0.12}
MEASURED = {"tensile_strength_mpa": (430.0, -17.0, 8.0), "hardness_hv": (120.0, -3.0, 3.5), "elongation_pct": (9.5, -0.95, 1.0), "surface_roughness_ra": (1.35, 0.15, 0.12)}


def uniform(seed: int, purpose: str, *keys: str) -> Column:
    """In (0, 1), by hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, purpose: str, *keys: str) -> Column:
    """Box and Muller's way, from two uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, purpose + "/r", *keys))) * F.cos(2 * math.pi * uniform(seed, purpose + "/a", *keys))


def padded(n: Column, width: int) -> Column:
    """n with leading zeros; longer numbers keep all their digits, which lpad would cut."""
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def chosen(u: Column, shares: dict[str, float | Column]) -> Column:
    """The name whose stretch of the shares, laid end to end, holds u times their sum."""
    total = sum((F.lit(s) if isinstance(s, float) else s for s in shares.values()), F.lit(0.0))
    edge, out, pairs = F.lit(0.0), None, list(shares.items())
    for name, share in pairs:
        edge = edge + share
        out = F.when(u * total < edge, name) if out is None else out.when(u * total < edge, name)
    return out.otherwise(pairs[-1][0])


def material_batches(spark: SparkSession, seed: int = SEED, batches: int = BATCHES) -> DataFrame:
    ids = spark.range(1, batches + 1).select(F.concat(F.lit("B"), padded(F.col("id"), 2)).alias("batch_id"))
    df = ids.withColumn("material_supplier", chosen(uniform(seed, "supplier", "batch_id"), {s: p for s, (p, _) in SUPPLIERS.items()}))
    moved = F.create_map(*[F.lit(x) for s, (_, m) in SUPPLIERS.items() for x in (s, m)])
    return df.select(
        "batch_id", "material_supplier",
        F.bround(3.05 + moved[F.col("material_supplier")] + 0.28 * normal(seed, "moisture", "batch_id"), 3).alias("material_moisture_pct"),
        F.bround(62 + 9 * normal(seed, "particle", "batch_id"), 2).alias("material_particle_size_um"),
        F.expr("timestamp_ntz'2025-02-20 00:00:00'").alias("t0"), F.floor(10 * uniform(seed, "received", "batch_id")).alias("d"),
    ).withColumn("received_date", F.expr("t0 + make_dt_interval(cast(d AS int))")).drop("t0", "d")


def production_runs(batches: DataFrame, seed: int = SEED, runs_per_batch: int = RUNS_PER_BATCH) -> DataFrame:
    """The runs, and z: the logit of failure, which save() leaves out."""
    runs = batches.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(runs_per_batch - 1))))
    runs = runs.withColumn("i", (F.substring("batch_id", 2, 9).cast("int") - 1) * runs_per_batch + F.col("r"))
    runs = runs.withColumn("run_id", F.concat(F.lit("R"), padded(F.col("i") + 1, 3)))
    minutes = F.floor(90 * uniform(seed, "start", "run_id"))
    runs = runs.withColumn("m", (F.col("i") * 240 + minutes).cast("int")).withColumn("start_time", F.expr("timestamp_ntz'2025-03-03 06:00:00' + make_dt_interval(0, 0, m)"))
    runs = runs.withColumn("shift", F.element_at(F.array(*map(F.lit, SHIFTS)), (F.floor(F.pmod(F.hour("start_time") - 6, F.lit(24)) / 8) + 1).cast("int")))
    runs = runs.withColumn("machine_id", chosen(uniform(seed, "machine", "run_id"), {m: p for m, (p, _) in MACHINES.items()}))
    runs = runs.withColumn("operator_id", F.concat(F.lit("OP"), padded(F.floor(12 * uniform(seed, "operator", "run_id")) + 1, 2)))
    runs = runs.withColumn("furnace_temp_c", F.bround(BEST_TEMP + TEMP_SD * normal(seed, "temp", "run_id"), 2))
    for c in ("pressure_mpa", "line_speed_mpm", "cooling_rate_cps", "ambient_humidity_pct"):
        _, mean, sd = LINEAR[c]
        runs = runs.withColumn(c, F.bround(mean + sd * normal(seed, c, "run_id"), 3))
    runs = runs.withColumn("ambient_humidity_pct", F.least(F.greatest("ambient_humidity_pct", F.lit(22.0)), F.lit(88.0)))
    off = (F.col("furnace_temp_c") - BEST_TEMP) / TEMP_SD
    z = BASE_LOGIT + UNDERHEAT * off + (OVERHEAT - UNDERHEAT) * F.greatest(off, F.lit(0.0)) + RUN_NOISE * normal(seed, "run", "run_id")
    for c, (weight, mean, sd) in LINEAR.items():
        z = z + weight * (F.col(c) - mean) / sd
    for c, levels in (("machine_id", {m: e for m, (_, e) in MACHINES.items()}), ("shift", SHIFTS)):
        z = z + F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[F.col(c)]
    return runs.withColumn("z", z)


def inspection_results(runs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per unit; fails get a defect whose odds follow the run's conditions. Keeps z."""
    many = (LEAST_UNITS + F.floor((MOST_UNITS - LEAST_UNITS + 1) * uniform(seed, "units", "run_id"))).cast("int")
    units = runs.withColumn("u", F.explode(F.sequence(F.lit(1), many)))
    units = units.withColumn("unit_id", F.concat(F.lit("U"), F.substring("run_id", 2, 9), F.lit("-"), padded(F.col("u"), 2)))
    units = units.withColumn("z", F.col("z") + UNIT_NOISE * normal(seed, "unit", "unit_id"))
    units = units.withColumn("is_fail", (uniform(seed, "fail", "unit_id") < sigmoid(F.col("z"))).cast("int"))
    std = {c: (F.col(c) - mean) / sd for c, (_, mean, sd) in LINEAR.items()}
    off = (F.col("furnace_temp_c") - BEST_TEMP) / TEMP_SD
    supplier = F.when(F.col("material_supplier") == "SUP-C", 1.7).when(F.col("material_supplier") == "SUP-B", 1.15).otherwise(0.75)
    odds = {
        "PORE": 0.36 * F.exp(0.9 * std["material_moisture_pct"]),
        "CRACK": 0.18 * F.exp(0.9 * F.greatest(off, F.lit(0.0)) + 0.5 * std["cooling_rate_cps"]),
        "DIMENSION": 0.22 * F.exp(0.9 * std["line_speed_mpm"]),
        "CONTAMINATION": 0.13 * supplier,
        "EDGE": 0.11 * F.exp(0.9 * F.greatest(-off, F.lit(0.0))),
    }
    defect = F.when(F.col("is_fail") == 1, chosen(uniform(seed, "defect", "unit_id"), odds)).otherwise("NONE")
    return units.select(
        "unit_id", "run_id", "batch_id", "shift", chosen(uniform(seed, "method", "unit_id"), METHODS).alias("inspection_method"),
        F.concat(F.lit("INS"), (F.floor(8 * uniform(seed, "inspector", "unit_id")) + 1).cast("string")).alias("inspector_id"),
        defect.alias("defect_type"), "is_fail", F.expr("start_time + interval '6' hour").alias("inspection_ts"), "z",
    )


def perf_tests(units: DataFrame, seed: int = SEED) -> DataFrame:
    """Destructive tests of a share of the units, one to three repeats, some readings missing."""
    tested = units.where(uniform(seed, "tested", "unit_id") < TESTED)
    repeats = F.element_at(F.array(*map(F.lit, (1, 1, 1, 1, 2, 3))), (F.floor(6 * uniform(seed, "repeats", "unit_id")) + 1).cast("int"))
    rows = tested.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), repeats)))
    centred = F.col("z") - BASE_LOGIT
    values = []
    for c, (mean, slope, sd) in MEASURED.items():
        x = F.bround(mean + slope * centred + sd * normal(seed, c, "unit_id", "repeat_no"), 3)
        values.append(F.when(uniform(seed, c + "/missing", "unit_id", "repeat_no") >= TEST_MISSING, x).alias(c))
    return rows.select("unit_id", "run_id", "repeat_no", *values, F.expr("inspection_ts + interval '1' day").alias("test_ts"))


def _picked(df: DataFrame, n: int, seed: int, purpose: str, key: str, where: str = "true") -> list:
    """The n keys of least hash: a handful, by a distributed top-n."""
    rows = df.where(where).select(key).distinct().orderBy(F.xxhash64(F.lit(seed), F.lit(purpose), key), key).limit(n).collect()
    return [r[0] for r in rows]


def inject_known_anomalies(runs: DataFrame, units: DataFrame, perf: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Known defects, in exact numbers: impossible temperatures, missing inspectors and machines, a constant and a near-constant column, repeated rows, an extra test, weak tensile readings."""
    hot = ["R007", "R023", "R041"]
    machines, inspectors = _picked(runs, 3, seed, "machine", "run_id"), _picked(units, 5, seed, "inspector", "unit_id")
    n = units.count()
    archived, twice = _picked(units, max(1, round(0.004 * n)), seed, "archived", "unit_id"), _picked(units, 2, seed, "twice", "unit_id")
    extra = _picked(perf, 1, seed, "extra", "unit_id", "repeat_no = 1")
    weak = _picked(perf, 6, seed, "weak", "unit_id", "repeat_no = 1 AND tensile_strength_mpa IS NOT NULL")
    runs = runs.withColumn("furnace_temp_c", F.when(F.col("run_id").isin(hot), 9999.0).otherwise(F.col("furnace_temp_c")))
    runs = runs.withColumn("machine_id", F.when(~F.col("run_id").isin(machines), F.col("machine_id")))
    units = units.withColumn("inspector_id", F.when(~F.col("unit_id").isin(inspectors), F.col("inspector_id")))
    units = units.withColumns({"plant_code": F.lit("PLANT-01"), "is_archived": F.col("unit_id").isin(archived)})
    units = units.unionByName(units.where(F.col("unit_id").isin(twice)))
    last = Window.partitionBy("unit_id").orderBy(F.desc("repeat_no"))
    more = perf.where(F.col("unit_id").isin(extra)).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n").withColumn("repeat_no", F.col("repeat_no") + 1)
    perf = perf.unionByName(more)
    low = F.bround(255 + 40 * uniform(seed, "low", "unit_id"), 3)
    perf = perf.withColumn("tensile_strength_mpa", F.when(F.col("unit_id").isin(weak) & (F.col("repeat_no") == 1), low).otherwise(F.col("tensile_strength_mpa")))
    manifest = {"out_of_range_runs": hot, "missing_machine_runs": machines, "missing_inspector_units": inspectors, "constant_column": "plant_code", "archived_units": len(archived), "duplicated_units": twice, "extra_repeat_units": extra, "weak_tensile_units": weak}
    return runs, units, perf, manifest


def ground_truth() -> dict[str, list[str]]:
    return {
        "primary": ["furnace_temp_c", "material_moisture_pct", "pressure_mpa"], "secondary": ["machine_id", "line_speed_mpm", "cooling_rate_cps", "shift"],
        "indirect": ["material_supplier"], "decoy": ["ambient_humidity_pct", "operator_id", "material_particle_size_um"],
    }


def generate_all(spark: SparkSession, seed: int = SEED, batches: int = BATCHES) -> tuple[dict[str, DataFrame], dict]:
    material = material_batches(spark, seed, batches)
    runs = production_runs(material, seed)
    units = inspection_results(runs, seed)
    perf = perf_tests(units, seed)
    runs, units, perf, manifest = inject_known_anomalies(runs, units, perf, seed)
    found = {"material_batches": material, "production_runs": runs, "inspection_results": units, "perf_tests": perf}
    own = {name: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]]) for name, df in found.items()}
    return own, {"seed": seed, "anomalies": manifest, "ground_truth_mechanism": ground_truth()}


def ensure_raw_data(spark: SparkSession, data_dir: str, seed: int = SEED, regenerate: bool = False) -> tuple[dict[str, DataFrame], dict, bool]:
    """Made if any table is missing or if asked for, always read back from disk, so both ways give the same types."""
    there = all(tables.exists(spark, f"{data_dir}/{name}.csv") for name in TABLES)
    manifest: dict = {}
    if regenerate or not there:
        made, manifest = generate_all(spark, seed)
        tables.save_raw_tables(made, data_dir)
        tables.write_json(manifest, f"{data_dir}/synthetic_manifest.json", spark)
    else:
        manifest = tables.read_json(spark, f"{data_dir}/synthetic_manifest.json") or {}
    return tables.load_raw_tables(spark, data_dir), manifest, regenerate or not there
