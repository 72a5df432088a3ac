"""Ordered prefix sums without one big partition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges a key's values are cut into: one for each shuffle partition of the session, within these limits.
LEAST_CUTS, MOST_CUTS = 64, 1024


def cuts_of(spark: SparkSession) -> int:
    return max(LEAST_CUTS, min(MOST_CUTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ranged(df: DataFrame, edges: DataFrame, keys: Sequence[str], value: str, ends: str, name: str, closed: str = "right") -> DataFrame:
    """df with the number of its key's ends (an ascending array in edges, one row per keys) that lie below its value, or, closed left, not above it.

    Each pair of neighbouring ends is a row of a small broadcast table that
    compiled code compares; a null value gets 0.
    """
    own = edges.select(*keys, F.coalesce(ends, F.array()).alias("__e")).select(*keys, "__e", F.explode(F.expr("sequence(0, size(__e))")).alias(name))
    own = own.select(*keys, name, F.expr(f"get(__e, {name} - 1)").alias("__lo"), F.expr(f"get(__e, {name})").alias("__hi"))
    v, lo, hi = F.col(value), F.col("__lo"), F.col("__hi")
    above, under = (v > lo, v <= hi) if closed == "right" else (v >= lo, v < hi)
    inside = (v.isNull() & (F.col(name) == 0)) | ((lo.isNull() | above) & (hi.isNull() | under))
    on = [df[k] == own[k] for k in keys]
    return df.join(F.broadcast(own), reduce(and_, [*on, inside])).drop(*[own[k] for k in keys], "__lo", "__hi")


def running(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], cuts: int | None = None) -> DataFrame:
    """df with x__before for each x of sums: its sum over the rows of the same keys with a smaller value.

    df has one row per keys and value. Approximate quantiles cut each key's
    values into ranges; sums run inside a range and start from the totals of
    the ranges before it, so the result is exact and a task holds one range.
    """
    cuts = cuts or cuts_of(df.sparkSession)
    at = F.array(*[F.lit((i + 1) / cuts) for i in range(cuts - 1)])
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, at, F.lit(10_000)).alias("__edges"))
    dealt = ranged(df, edges, keys, value, "__edges", "__range")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "__range").agg(*[F.sum(x).alias(x) for x in sums])
    totals = totals.select(*keys, "__range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"__{x}") for x in sums])
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"{x}__before": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums})
    out = own.join(totals, [*keys, "__range"])
    return out.withColumns({f"{x}__before": F.col(f"{x}__before") + F.col(f"__{x}") for x in sums}).drop("__range", *[f"__{x}" for x in sums])


def quantiles(run: DataFrame, keys: Sequence[str], value: str, n: str, at: Sequence[float]) -> DataFrame:
    """keys, total, q: the exact quantiles of the values, each counted n times, interpolated between neighbours; null without values.

    run is running(df, keys, value, [n, ...]). Only the rows at the wanted
    ranks, two a quantile, come together in one place.
    """
    totals = run.groupBy(*keys).agg(F.sum(n).alias("total"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos")) for i, p in enumerate(at)]))
    asked = totals.select(*keys, asked.alias("a")).select(*keys, "a.i", "a.pos").withColumn("__rank", F.explode(F.array(F.floor("pos"), F.ceil("pos"))))
    on = [run[k] == asked[k] for k in keys]
    held = (F.col("__rank") >= F.col(f"{n}__before")) & (F.col("__rank") < F.col(f"{n}__before") + F.col(n))
    found = run.join(F.broadcast(asked), reduce(and_, [*on, held])).drop(*[asked[k] for k in keys])
    ends = found.groupBy(*keys, "i").agg(F.max(F.col("pos") - F.floor("pos")).alias("part"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    listed = ends.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("q"))
    return totals.join(listed, list(keys), "left")
