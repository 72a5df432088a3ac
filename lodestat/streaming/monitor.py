"""Running quality counts over event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_quality(events: DataFrame, time: str, value: str, limits: tuple[float, float], key: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and key: rows, missing and out-of-range values, mean. On a stream, rows later than late are left out and state older than that is dropped."""
    lo, hi = limits
    x = F.col(value)
    groups = [F.window(time, window).alias("w"), *([F.col(key)] if key else [])]
    rows = events.withWatermark(time, late).groupBy(*groups)
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.count_if((x < lo) | (x > hi)).alias("n_out_of_range"), F.avg(x).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), *([key] if key else []), "n", "n_missing", "n_out_of_range", "mean")
