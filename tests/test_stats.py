import math
import random

import pytest
from pyspark.sql import functions as F

from lodestat.functions import jobs, special, stats


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(2.0, 1) == pytest.approx(math.erfc(1.0), abs=1e-12)
    assert special.two_sided_t(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-6)
    assert special.kolmogorov_sf(1.3580986) == pytest.approx(0.05, abs=1e-4)
    assert special.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-10)


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.06, 0.074, 0.205, 0.34]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(98, None), (99, float("nan"))], "i int, p_value double")
    got = {r["i"]: r for r in stats.benjamini_hochberg(df).collect()}
    for i, x in enumerate(p):
        brute = min(min(1.0, y * len(p) / (sorted(p).index(y) + 1)) for y in p if y >= x)
        assert got[i]["q"] == pytest.approx(brute)
    assert got[98]["q"] is None and got[99]["q"] is None and not got[99]["rejected"]


def flat(spark, a, b):
    return spark.createDataFrame([("f", float(x), True) for x in a] + [("f", float(x), False) for x in b], "factor string, value double, a boolean")


def test_mann_whitney(spark):
    r = stats.mann_whitney_u(flat(spark, range(10, 14), range(1, 5)), ["factor"], "a").first()
    assert r["u"] == 16 and r["rank_biserial"] == 1.0
    assert stats.mann_whitney_p(r["u"], 4, 4, r["ties"]) == pytest.approx(2 / 70)
    assert stats.mann_whitney_u(flat(spark, range(1, 5), range(10, 14)), ["factor"], "a").first()["rank_biserial"] == -1.0
    same = stats.mann_whitney_u(flat(spark, [1] * 20, [1] * 20), ["factor"], "a").first()
    assert stats.mann_whitney_p(same["u"], 20, 20, same["ties"]) is None


def test_ties_beyond_a_long(spark):
    """Four million equal values: the cube of their number is no long any more."""
    t = 4_000_000
    r = stats.mann_whitney_u(spark.range(t).select(F.lit("f").alias("factor"), F.lit(1.0).alias("value"), (F.col("id") % 2 == 0).alias("a")), ["factor"], "a").first()
    assert r["ties"] == pytest.approx(float(t**3 - t), rel=1e-15) and r["u"] == t * t / 8 and r["rank_biserial"] == 0


def test_welch_and_cohen(spark):
    row = stats.two_groups(flat(spark, [5, 6, 7, 8], [1, 2, 3, 4]), ["factor"], "a")
    assert row.select(stats.cohens_d().alias("d")).first()["d"] == pytest.approx(4 / math.sqrt(5 / 3))
    got = stats.welch_ttest(row.first().asDict())
    assert got["df"] == pytest.approx(6) and got["p_value"] < 0.01 and got["ci95"][0] > 0
    assert stats.welch_ttest(stats.two_groups(flat(spark, [1], [2, 2]), ["factor"], "a").first().asDict())["p_value"] is None


def test_chi_square(spark):
    rows = [("f", a, b) for a, b, n in (("x", 0, 80), ("x", 1, 20), ("y", 0, 20), ("y", 1, 80)) for _ in range(n)]
    r = stats.chi_square(spark.createDataFrame(rows, "factor string, a string, b int"), ["factor"], "a", "b").first()
    assert r["chi2"] == pytest.approx(72.0) and r["dof"] == 1 and r["cramers_v"] == pytest.approx(0.6)
    one = stats.chi_square(spark.createDataFrame([("f", "x", 0), ("f", "x", 1)], "factor string, a string, b int"), ["factor"], "a", "b").first()
    assert one["chi2"] is None


def test_spearman_and_kruskal(spark):
    cubes = spark.createDataFrame([("f", float(x), float(x**3)) for x in range(50)] + [("f", None, 1.0), ("g", 1.0, 2.0)], "factor string, x double, y double")
    got = {r["factor"]: r["rho"] for r in stats.spearman(cubes, ["factor"], "x", "y").collect()}
    assert got["f"] == pytest.approx(1.0) and got["g"] is None
    rng = random.Random(1)
    rows = [("f", g, rng.gauss(3.0 if g == "c" else 0.0, 1)) for g in "abc" for _ in range(100)]
    r = stats.kruskal(spark.createDataFrame(rows, "factor string, g string, v double"), ["factor"], "g", "v").first()
    assert r["n_groups"] == 3 and special.chi2_sf(r["h"], r["dof"]) < 1e-10


def test_cluster_permutation(spark):
    rows = [(f"c{c}", float(c), int(c >= 20)) for c in range(40) for _ in range(15)]
    df = spark.createDataFrame(rows, "c string, x double, y int")
    got = stats.cluster_permutation(df, "c", "x", "y", n_perm=99, seed=3)
    assert got["p_value"] == pytest.approx(1 / 100) and got["statistic"] == pytest.approx(20)
    again = stats.cluster_permutation(df.repartition(7), "c", "x", "y", n_perm=99, seed=3)
    assert again == got
    assert stats.cluster_permutation(df.where("y = 1"), "c", "x", "y", 9)["note"] == "single class"
    assert stats.cluster_permutation(df.where("x in (0, 39)"), "c", "x", "y", 9)["note"] == "fewer than 4 clusters"
    assert "varies" in stats.cluster_permutation(df.withColumn("x", F.col("x") + F.rand(1)), "c", "x", "y", 9)["note"]
    cat = stats.cluster_permutation(df.withColumn("x", (F.col("x") >= 20).cast("string")), "c", "x", "y", 99, kind="categorical")
    assert cat["statistic"] == pytest.approx(1.0) and cat["p_value"] == pytest.approx(0.01)


def test_information(spark):
    df = spark.range(600).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 300).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("z"))
    both = df.select("x", F.explode(F.array(F.struct(F.lit("y").alias("f"), F.col("y").alias("c")), F.struct(F.lit("z").alias("f"), F.col("z").alias("c")))).alias("p")).select("p.f", "p.c", "x")
    got = stats.neighbour_information(both, ["f"], "x", "c")
    assert got["y",] == pytest.approx(math.log(2), abs=0.05) and got["z",] < 0.05
    few = both.where("f = 'y' or x < 2")
    assert stats.neighbour_information(few, ["f"], "x", "c") == {("y",): pytest.approx(got["y",])}, "a group doesn't depend on the others"
    assert stats.neighbour_information(both.where("x < 300 and f = 'y'"), ["f"], "x", "c") == {}, "a single class"


def test_jobs_side_by_side(spark):
    assert jobs.each(lambda n: spark.range(n).count(), [3, 1, 2]) == [3, 1, 2]
    assert jobs.each(str, []) == []
    with pytest.raises(ZeroDivisionError):
        jobs.each(lambda n: 1 // n, [1, 0])


def test_discrete_information(spark):
    df = spark.range(600).select((F.col("id") >= 300).cast("int").alias("y"))
    r = stats.mutual_information(df.withColumn("f", F.lit(1)), ["f"], "y", "y").first()
    assert r["mi"] == pytest.approx(math.log(2))
