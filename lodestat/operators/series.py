"""Ordered series: trend tests, autocorrelation, one-step forecasts and their backtest.

A series is the rows of one name: (series, pos, value), pos from 0 without
gaps, missing values taken out first. Series are short (one point per batch
or run); many of them run side by side, each within its own partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..schema import ALPHA

GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def series_of(df: DataFrame, key: str, value: str, time: str | None = None, name: str | None = None) -> DataFrame:
    """series, pos, key, value (mean), n_units, order_time: groups by first time, then key; without time by key."""
    grouped = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n_units"), (F.min(time) if time else F.lit(None).cast("timestamp_ntz")).alias("order_time"))
    return positioned(grouped.where("value is not null").withColumn("series", F.lit(name or value)), ["order_time", "key"])


def positioned(df: DataFrame, order: list[str]) -> DataFrame:
    """Positions 0, 1, ... within each series, missing and non-finite values out."""
    ok = df.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return ok.withColumn("pos", (F.row_number().over(Window.partitionBy("series").orderBy(*[F.asc_nulls_last(c) for c in order])) - 1).cast("long"))


def _own() -> Window:
    return Window.partitionBy("series").orderBy("pos")


def moving_average(df: DataFrame, window: int = 5) -> DataFrame:
    """df with the trailing mean of window values, null until there are so many."""
    frame = _own().rowsBetween(-(window - 1), 0)
    return df.withColumn("moving_average", F.when((F.count("value").over(frame) == window) & (F.lit(window) >= 2), F.avg("value").over(frame)))


def _regression(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Slope, intercept and r squared over complete pairs; null without spread of x, r squared 0 without spread of y."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    vx, vy, c = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    slope = F.when(vx > 0, c / vx)
    return slope, F.when(vx > 0, F.avg(b) - c / vx * F.avg(a)), F.when(vx > 0, F.when(vy > 0, c * c / (vx * vy)).otherwise(0.0))


def linear_trend(df: DataFrame) -> DataFrame:
    """series, n, slope, intercept, r2 over positions; null under 3 points."""
    s, i, r2 = _regression(F.col("pos").cast("double"), F.col("value"))
    got = df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), s.alias("slope"), i.alias("intercept"), r2.alias("r2"))
    return got.select("series", "n", *[F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def pairs(df: DataFrame) -> DataFrame:
    """All (earlier, later) points of each series; short series only, as each test on them says."""
    a, b = df.select("series", F.col("pos").alias("i"), F.col("value").alias("yi")), df.select("series", F.col("pos").alias("j"), F.col("value").alias("yj"))
    return a.join(b, "series").where("i < j")


def sen_slope(df: DataFrame) -> DataFrame:
    return pairs(df).groupBy("series").agg(F.median((F.col("yj") - F.col("yi")) / (F.col("j") - F.col("i"))).alias("sen_slope"))


def rises(df: DataFrame) -> DataFrame:
    """series, s: pairs of points that rise with time less those that fall, in n log n.

    Two positions first differ in one binary place; at that level they are in
    one block, the earlier in its left half. So at each level every point of a
    right half is held against the left half of its block, by running counts
    over the block's values.
    """
    sized = df.join(df.groupBy("series").agg(F.max("pos").alias("__last")), "series").where("__last > 0")
    at = sized.select("series", "value", "pos", F.explode(F.expr("sequence(0, cast(floor(log2(__last)) AS int))")).alias("level"))
    halves = at.select("series", "value", "level", F.expr("shiftright(pos, level + 1)").alias("block"), F.expr("1 - (shiftright(pos, level) & 1)").alias("left"))
    block = Window.partitionBy("series", "level", "block")
    upto = F.sum("left").over(block.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    alike = F.sum("left").over(Window.partitionBy("series", "level", "block", "value"))
    held = halves.select("series", "left", (2 * upto - alike - F.sum("left").over(block)).alias("d"))
    return held.where("left = 0").groupBy("series").agg(F.sum("d").cast("long").alias("s"))


def mann_kendall(df: DataFrame) -> DataFrame:
    """series, n, s, var_s (tie corrected), z (continuity corrected), sen_slope; z null under 3 points or without variance.

    The test is in n log n; the slope is the median over all pairs, for series of a point per batch or run.
    """
    s = rises(df).join(sen_slope(df), "series", "left")
    ties = df.groupBy("series", "value").agg(F.count(F.lit(1)).alias("t")).groupBy("series").agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("q"))
    out = ties.join(s, "series", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    out = out.withColumn("var_s", (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("q")) / 18.0)
    z = F.when((F.col("n") >= 3) & (F.col("var_s") > 0), (F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt("var_s"))
    return out.select("series", "n", "s", "var_s", z.alias("z"), "sen_slope")


def lag1(df: DataFrame) -> DataFrame:
    """series, n, r1: Pearson's r of neighbours; null under 4 points or without spread."""
    from ..functions.stats import correlation

    near = df.withColumn("before", F.lag("value").over(_own()))
    got = near.groupBy("series").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("before"), F.col("value")).alias("r1"))
    return got.select("series", "n", F.when(F.col("n") >= 4, F.col("r1")).alias("r1"))


def _arrays(df: DataFrame) -> DataFrame:
    return df.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("ys"))


def _smooth(ys: str, alpha: str) -> str:
    """SQL: level, stale (the forecast of the last point) and sse of one-step forecasts, the first point being the first level."""
    return f"aggregate(slice({ys}, 2, size({ys})), named_struct('level', {ys}[0], 'stale', {ys}[0], 'sse', 0D), (a, y) -> named_struct('level', {alpha} * y + (1 - {alpha}) * a.level, 'stale', a.level, 'sse', a.sse + (y - a.level) * (y - a.level)))"


def smoothing(df: DataFrame, alpha: float | None = None) -> DataFrame:
    """series, n, alpha, sse, next_forecast, last_level; alpha of least squared one-step error on the grid (the smaller on ties).

    next_forecast is the forecast made for the last point, one step behind
    last_level, which has taken in the last point too. Null under 3 points; a
    flat series gets alpha 0.5.
    """
    grid = F.explode(F.array(*map(F.lit, GRID if alpha is None else [alpha])))
    rows = _arrays(df).withColumn("alpha", grid).withColumn("r", F.expr(_smooth("ys", "alpha")))
    best = rows.groupBy("series").agg(F.first(F.size("ys")).alias("n"), F.first(F.expr("array_max(ys) = array_min(ys)")).alias("flat"), F.min(F.struct(F.col("r.sse").alias("sse"), "alpha", F.col("r.stale").alias("stale"), F.col("r.level").alias("level"))).alias("b"))
    long = F.col("n") >= 3
    a = F.when(F.col("flat") & F.lit(alpha is None), 0.5).otherwise(F.col("b.alpha"))
    return best.select("series", F.col("n").cast("long").alias("n"), F.when(long, a).alias("alpha"), F.when(long, F.col("b.sse")).alias("sse"), F.when(long, F.col("b.stale")).alias("next_forecast"), F.when(long, F.col("b.level")).alias("last_level"))


def ar1(df: DataFrame) -> DataFrame:
    """series, n, phi, c, r2, next_forecast by regression on the value before; null under 5 points or if those are flat."""
    near = df.withColumn("before", F.lag("value").over(_own()))
    s, i, r2 = _regression(F.col("before"), F.col("value"))
    got = near.groupBy("series").agg(F.count(F.lit(1)).alias("n"), s.alias("phi"), i.alias("c"), r2.alias("r2"), F.max_by("value", "pos").alias("last"))
    got = got.select("series", "n", *[F.when(F.col("n") >= 5, F.col(x)).alias(x) for x in ("phi", "c", "r2")], "last")
    return got.withColumn("next_forecast", F.col("c") + F.col("phi") * F.col("last")).drop("last")


def backtest_points(df: DataFrame, min_train: int = 5) -> DataFrame:
    """series, pos, value and what each method, fitted on the points before alone, says: ses, ar1, mean, last."""
    before = _own().rowsBetween(Window.unboundedPreceding, -1)
    near = df.withColumn("before", F.lag("value").over(_own()))
    x, y = F.when(F.col("before").isNotNull(), F.col("before")), F.when(F.col("before").isNotNull(), F.col("value"))
    vx = F.var_pop(x).over(before)
    phi = F.when(vx > 0, F.covar_pop(x, y).over(before) / vx)
    level = F.avg(y).over(before) - phi * F.avg(x).over(before)
    rows = near.withColumns({"last": F.col("before"), "mean": F.avg("value").over(before), "ar1": F.coalesce(level + phi * F.col("before"), F.col("before"))})
    rows = rows.where(F.col("pos") >= min_train)
    history = rows.join(_arrays(df), "series").withColumn("ys", F.expr("slice(ys, 1, cast(pos AS int))")).withColumn("alpha", F.explode(F.array(*map(F.lit, GRID)))).withColumn("r", F.expr(_smooth("ys", "alpha")))
    best = history.groupBy("series", "pos").agg(F.min(F.struct(F.col("r.sse").alias("sse"), "alpha", F.col("r.level").alias("level"))).alias("b")).select("series", "pos", F.col("b.level").alias("ses"))
    return rows.join(best, ["series", "pos"]).select("series", "pos", "value", "ses", "ar1", "mean", "last")


def backtest(df: DataFrame, min_train: int = 5) -> DataFrame:
    """series, method, n, mae, rmse."""
    flat = backtest_points(df, min_train).unpivot(["series", "pos", "value"], ["ses", "ar1", "mean", "last"], "method", "forecast")
    e = F.col("forecast") - F.col("value")
    return flat.groupBy("series", "method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def trend_label(p: float | None, slope: float | None, alpha: float = ALPHA) -> str:
    if p is None or slope is None or p >= alpha:
        return "no trend"
    return "rising" if slope > 0 else "falling" if slope < 0 else "no trend"


def analyze(df: DataFrame, min_train: int = 5, alpha: float = ALPHA) -> dict[str, dict]:
    """Each series' tests, forecasts, best method and a word on its state of control; small results on the driver."""
    by = lambda f: {r["series"]: r.asDict() for r in f.collect()}
    mk, trend, auto, smooth, auto1 = by(mann_kendall(df)), by(linear_trend(df)), by(lag1(df)), by(smoothing(df)), by(ar1(df))
    errors: dict[str, list[dict]] = {}
    for r in backtest(df, min_train).collect():
        errors.setdefault(r["series"], []).append(r.asDict())
    out = {}
    for s, m in mk.items():
        n = m["n"]
        p = special.two_sided_z(m["z"]) if m["z"] is not None else None
        r2 = trend[s]["r2"]
        t_p = special.two_sided_t(math.sqrt(r2 * (n - 2) / (1 - r2)), n - 2) if r2 is not None and r2 < 1 and n > 2 else 0.0 if r2 == 1 else None
        r1 = auto[s]["r1"]
        r1_p = special.two_sided_t(r1 * math.sqrt((n - 3) / (1 - r1 * r1)), n - 3) if r1 is not None and abs(r1) < 1 and n > 3 else None
        label, linked = trend_label(p, m["sen_slope"], alpha), r1_p is not None and r1_p < alpha
        ranked = sorted(errors.get(s, []), key=lambda e: (e["mae"], ("ses", "ar1", "mean", "last").index(e["method"])))
        state = ("trend and autocorrelation: not in control" if linked else "trend: drifting") if label != "no trend" else "autocorrelated without trend" if linked else "no evidence against stable"
        out[s] = {"n": n, "mann_kendall": m | {"p_value": p, "trend": label}, "linear": trend[s] | {"p_value": t_p}, "lag1": auto[s] | {"p_value": r1_p, "significant": linked}, "smoothing": smooth[s], "ar1": auto1[s], "backtest": ranked, "best": ranked[0]["method"] if ranked else None, "note": None if n >= min_train + 2 else "series too short for a backtest", "state": state}
    return out
