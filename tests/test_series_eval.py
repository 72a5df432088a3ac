import math
import random

import pytest
from pyspark.sql import functions as F

from lodestat.operators import cluster, evaluate, models, series


def points(spark, ys):
    df = spark.createDataFrame([("s", i, None if y is None else float(y)) for i, y in enumerate(ys)], "series string, i int, value double")
    return series.positioned(df, ["i"])


def test_moving_average(spark):
    df = points(spark, [1, 2, 3, 4, 5])
    assert [r["moving_average"] for r in series.moving_average(df, 2).orderBy("pos").collect()] == [None, 1.5, 2.5, 3.5, 4.5]
    for w in (10, 1):
        assert all(r["moving_average"] is None for r in series.moving_average(df, w).collect())


def test_mann_kendall(spark):
    up = series.analyze(points(spark, range(30)))["s"]
    assert up["mann_kendall"]["trend"] == "rising" and up["mann_kendall"]["sen_slope"] == 1.0 and up["linear"]["slope"] == pytest.approx(1.0)
    flat = series.mann_kendall(points(spark, [3] * 10)).first()
    assert flat["s"] == 0 and flat["z"] is None and flat["sen_slope"] == 0
    gap = series.mann_kendall(points(spark, [1, None, 2, 3, 4])).first()
    assert gap["n"] == 4 and gap["s"] == 6


def test_linear_trend(spark):
    r = series.linear_trend(points(spark, [1, 2, 3, 4, 5])).first()
    assert r["slope"] == pytest.approx(1) and r["r2"] == pytest.approx(1)
    assert series.linear_trend(points(spark, [1, 2])).first()["slope"] is None


def test_smoothing_and_ar1(spark):
    flat = series.smoothing(points(spark, [10] * 20)).first()
    assert flat["alpha"] == 0.5 and flat["next_forecast"] == 10
    rng, y = random.Random(4), [0.0]
    for _ in range(400):
        y.append(0.8 * y[-1] + rng.gauss(0, 1))
    assert series.ar1(points(spark, y)).first()["phi"] == pytest.approx(0.8, abs=0.1)
    assert series.ar1(points(spark, [1] * 10)).first()["phi"] is None
    ys = [3.0, 4.0, 2.0, 5.0]
    got = series.smoothing(points(spark, ys), alpha=0.5).first()
    assert got["next_forecast"] == 2.75 and got["last_level"] == 3.875


def test_backtest(spark):
    got = {r["method"]: r for r in series.backtest(points(spark, range(12))).collect()}
    assert len(got) == 4 and got["last"]["n"] == 7 and got["last"]["mae"] == 1.0 and got["ar1"]["mae"] == pytest.approx(0, abs=1e-9)


def frame(spark, y, p):
    return spark.createDataFrame(list(zip(range(len(y)), y, p, strict=True)), "i int, y int, p double")


def test_metrics(spark):
    """Ten parcels, five of them damaged, of which a scale flags four and one whole one besides."""
    damaged = {2, 3, 5, 8, 9}
    weight = [0.15, 0.55, 0.95, 0.65, 0.35, 0.85, 0.25, 0.45, 0.75, 0.50]
    y = [int(i in damaged) for i in range(10)]
    df = frame(spark, y, weight)
    m = evaluate.metrics(df, "y", "p", F.col("p") > 0.52)
    # above 0.52: 2, 5, 8, 3 (damaged) and 1 (whole); 9 is missed
    assert m["confusion_matrix"] == [[4, 1], [1, 4]] and m["precision"] == m["recall"] == pytest.approx(0.8) and m["accuracy"] == 0.8
    # by falling weight: four damaged, one whole, the fifth damaged at place 6
    assert m["average_precision"] == pytest.approx((4 + 5 / 6) / 5)
    # of 25 pairs only (9, 1) is the wrong way round
    assert m["roc_auc"] == pytest.approx(24 / 25)
    assert m["brier"] == pytest.approx(sum((a - b) ** 2 for a, b in zip(weight, y, strict=True)) / 10)
    one = evaluate.metrics(frame(spark, [1, 1], [0.5, 0.6]), "y", "p", F.col("p") > 0.55)
    assert one["single_class"] and one["roc_auc"] is None and one["balanced_accuracy"] is None
    none = evaluate.metrics(df.where("false"), "y", "p", F.col("p") > 1)
    assert none["n"] == 0 and none["f1"] is None


def test_threshold(spark):
    got = evaluate.threshold(frame(spark, [0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8]), "y", "p")
    assert got["threshold"] == 0.7 and got["score"] == 1
    assert evaluate.threshold(frame(spark, [1, 1], [0.1, 0.2]), "y", "p")["threshold"] == 0.5


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 4.0), (4.0, 5.0), (None, 1.0)], "y double, p double")
    r = evaluate.regression_metrics(df, "y", "p").first()
    assert r["n"] == 4 and r["mae"] == 1 and r["rmse"] == 1 and r["r2"] == pytest.approx(1 - 1 / 1.25)
    assert evaluate.regression_metrics(df.withColumn("y", F.lit(1.0)), "y", "p").first()["r2"] is None


def test_split_and_folds(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    got = {(r["y"], r["part"]): r["count"] for r in evaluate.split(df, "y", ("id",)).groupBy("y", "part").count().collect()}
    assert got == {(0, "test"): 80, (0, "validation"): 64, (0, "train"): 256, (1, "test"): 20, (1, "validation"): 16, (1, "train"): 64}
    a = {r["id"]: r["part"] for r in evaluate.split(df.repartition(7), "y", ("id",)).collect()}
    assert a == {r["id"]: r["part"] for r in evaluate.split(df, "y", ("id",)).collect()}
    assert {r["count"] for r in evaluate.folds(df, "y", ("id",)).groupBy("y", "fold").count().collect()} == {80, 20}


def test_oversampled(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") < 30).cast("int").alias("y"))
    out, added = models.oversampled(df, "y", ("id",))
    assert out.count() == 540 and added == 240 and out.where("y = 1").count() == 270


def test_clusters(spark):
    rng = random.Random(2)
    rows = [(i, 1, c * 10 + rng.gauss(0, 0.5), c * -5 + rng.gauss(0, 0.5), "PORE" if c else "EDGE") for i, c in enumerate([0, 1] * 40)]
    df = spark.createDataFrame(rows, "unit_id int, is_fail int, furnace_temp_c double, pressure_mpa double, defect_type string")
    got = cluster.run_clustering(df, candidates=(2, 3), starts=2)
    assert got["best_k"] == 2 and got["k_selection"][0]["silhouette"] > 0.5 and got["n_clustered"] == 80
    assert all(r["share"] == 1.0 for r in got["composition"])
    assert cluster.run_clustering(df.limit(3))["note"] == "fewer than 4 failures"


def test_silhouette_is_exact_beyond_a_block(spark, monkeypatch):
    from lodestat.operators import cluster

    rows = [(i, i % 3, float(i % 3) * 2 + (i * 37 % 11) / 5, float(i * 53 % 13)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, x double, y double")
    whole = cluster.silhouette(df, ["x", "y"], "label", "id").first()
    monkeypatch.setattr(cluster, "PAIRWISE_ROWS", 50)
    blocks = cluster.silhouette(df, ["x", "y"], "label", "id").first()
    assert whole["n"] == blocks["n"] == 120 and abs(whole["silhouette"] - blocks["silhouette"]) < 1e-12
    assert abs(whole["silhouette"] - cluster.simplified_silhouette(df, ["x", "y"], "label").first()["silhouette"]) > 1e-6


def test_rises_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    many = {f"s{n}": [float(rng.randrange(6)) for _ in range(n)] for n in (1, 2, 3, 7, 8, 9, 33, 100)}
    df = spark.createDataFrame([(s, i, y) for s, ys in many.items() for i, y in enumerate(ys)], "series string, pos long, value double")
    got = {r["series"]: r["s"] for r in series.rises(df).collect()}
    sign = lambda x: (x > 0) - (x < 0)
    for s, ys in many.items():
        assert got.get(s, 0) == sum(sign(ys[j] - ys[i]) for j in range(len(ys)) for i in range(j))


def test_silhouette_by_brute_force(spark, monkeypatch):
    """Copies, points far from zero, a row alone in its cluster; a null feature or label makes no pair, but a row that scores 0."""
    rng = random.Random(5)
    rows = [(i, "abc"[i % 3], 1e6 + (i % 3) * 1e-2 + rng.gauss(0, 0.01), rng.gauss(0, 1) if i % 4 else -1e5) for i in range(90)]
    rows += [(100 + i, *rows[i][1:]) for i in range(30)] + [(200, "alone", 0.0, 0.0)]
    off = [(300, None, 1e6, 0.0), (301, "a", None, 0.0)]
    total = 0.0
    for k, lab, *p in rows:
        far = {m: [math.dist(p, q) for j, n, *q in rows if n == m and j != k] for m in ("a", "b", "c", "alone")}
        means = {m: sum(d) / len(d) for m, d in far.items() if d}
        if lab in means:
            a, b = means[lab], min(d for m, d in means.items() if m != lab)
            total += (b - a) / max(a, b)
    df = spark.createDataFrame(rows + off, "id long, label string, x double, y double")
    for block in (20_000, 40):
        monkeypatch.setattr(cluster, "PAIRWISE_ROWS", block)
        got = cluster.silhouette(df, ["x", "y"], "label", "id").first()
        assert got["n"] == len(rows) + 2 and got["silhouette"] == pytest.approx(total / (len(rows) + 2), abs=1e-9)
    assert cluster.silhouette(df.where("id < 100 and label = 'a'"), ["x", "y"], "label", "id").first()["silhouette"] == 0
    assert cluster.silhouette(df.where("id = 200"), ["x", "y"], "label", "id").first().asDict() == {"n": 0, "silhouette": None}
