"""Roles of columns, so that the same operators run on any table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SEED, ALPHA, N_PERM, CV_FOLDS, TEST_SHARE, VALIDATION_SHARE = 20240617, 0.05, 1000, 5, 0.20, 0.20
DRIFT_BINS, DRIFT_KS_ALPHA, DRIFT_KS_STATISTIC, DRIFT_PSI, DRIFT_WATCH, BASELINE_SHARE, NEAR_CONSTANT = 10, 0.01, 0.20, 0.25, 0.10, 0.25, 0.99


@dataclass(frozen=True)
class QualitySchema:
    """Which columns are keys, label, factors and measurements, and their limits."""

    label: str = "is_fail"
    unit: str = "unit_id"
    run: str = "run_id"
    batch: str = "batch_id"
    time: str = "start_time"
    defect: str = "defect_type"
    run_numeric: tuple[str, ...] = ("furnace_temp_c", "pressure_mpa", "line_speed_mpm", "cooling_rate_cps", "ambient_humidity_pct")
    batch_numeric: tuple[str, ...] = ("material_moisture_pct", "material_particle_size_um")
    run_categorical: tuple[str, ...] = ("machine_id", "shift", "operator_id")
    batch_categorical: tuple[str, ...] = ("material_supplier",)
    measured: tuple[str, ...] = ("tensile_strength_mpa", "hardness_hv", "elongation_pct", "surface_roughness_ra")
    limits: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(LIMITS))

    @property
    def numeric(self) -> tuple[str, ...]:
        return self.run_numeric + self.batch_numeric

    @property
    def categorical(self) -> tuple[str, ...]:
        return self.run_categorical + self.batch_categorical

    @property
    def factors(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def leaky(self) -> tuple[str, ...]:
        """Known only after the unit was judged; never a model's input."""
        return (*self.measured, self.defect, *(f"{c}_was_missing" for c in self.measured))

    def level(self, factor: str) -> str:
        """The key within which the factor is constant."""
        return self.batch if factor in self.batch_numeric + self.batch_categorical else self.run


#: The allowed range of each numeric column, inclusive.
LIMITS = {
    "furnace_temp_c": (1420.0, 1580.0),
    "pressure_mpa": (2.20, 3.80),
    "line_speed_mpm": (10.0, 32.0),
    "cooling_rate_cps": (4.0, 12.0),
    "ambient_humidity_pct": (20.0, 90.0),
    "material_moisture_pct": (1.50, 5.50),
    "material_particle_size_um": (20.0, 120.0),
    "tensile_strength_mpa": (300.0, 560.0),
    "hardness_hv": (95.0, 145.0),
    "elongation_pct": (2.50, 18.00),
    "surface_roughness_ra": (0.10, 2.60),
}

DEFAULT = QualitySchema()


def _fields(*parts: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "t": T.TimestampNTZType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (p.split(":") for p in parts)])


#: The four source tables as they are stored.
TABLES = {
    "material_batches": _fields("batch_id:s", "material_supplier:s", "material_moisture_pct:d", "material_particle_size_um:d", "received_date:t"),
    "production_runs": _fields("run_id:s", "batch_id:s", "start_time:t", "machine_id:s", "shift:s", "operator_id:s", *(f"{c}:d" for c in DEFAULT.run_numeric)),
    "inspection_results": _fields("unit_id:s", "run_id:s", "batch_id:s", "shift:s", "inspection_method:s", "inspector_id:s", "defect_type:s", "is_fail:i", "inspection_ts:t", "plant_code:s", "is_archived:b"),
    "perf_tests": _fields("unit_id:s", "run_id:s", "repeat_no:i", *(f"{c}:d" for c in DEFAULT.measured), "test_ts:t"),
}
