"""Learners over counted rows, against rows one by one, Spark ML and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import cells, evaluate, models


@pytest.fixture(scope="module")
def rows(spark):
    """4,000 rows of 10 x 4 x 3 values, of which u and z matter."""
    rng = random.Random(8)
    made = []
    for i in range(4000):
        x, y, z = rng.randrange(10), rng.randrange(4), rng.choice("abc")
        made.append((i, float(x), float(y), z, int(rng.random() < 1 / (1 + math.exp(4 - x + 2 * (z == "b"))))))
    return spark.createDataFrame(made, "id long, u double, y double, z string, label int").cache()


def learned(name, rows, **more):
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    (got,), model, names, _ = models.scored(name, train, [test], "label", ["u", "y"], ["z"], ("id",), **more)
    return got, model, names


def ap(df):
    return evaluate.ranking_metrics(df, "label", "score").first()["average_precision"]


def test_cells_hold_every_row(spark, rows):
    make, _ = models.preprocessed(rows, ["u", "y"], ["z"])
    x, n = cells.counted(rows, "label", ["u", "y", "z"], make)
    assert len(x) == 120 and n.sum() == 4000 and n[:, 1].sum() == rows.where("label = 1").count()


def test_forest_of_counts(rows, monkeypatch):
    """As good as Spark ML's over rows, its shares add up, and beyond the limit of cells Spark ML learns."""
    got, model, names = learned("random_forest", rows, trees=40)
    assert isinstance(model, cells.Model) and got.count() == 1000
    again, *_ = learned("random_forest", rows.repartition(5), trees=40)
    assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx({r["id"]: r["score"] for r in again.collect()})
    found = models.importance(model, names)
    assert found[0]["feature"] == "u" and sum(f["importance"] for f in found) == pytest.approx(1)
    monkeypatch.setattr(cells, "CELLS", 50)
    plain, spark_model, _ = learned("random_forest", rows, trees=40)
    assert not isinstance(spark_model, cells.Model) and ap(got) == pytest.approx(ap(plain), abs=0.03)


def test_one_tree_by_brute_force():
    """The first cut is the best of all cuts of all features, sides of too few rows left out."""
    rng = np.random.default_rng(4)
    bins, n = rng.integers(0, 6, (80, 3)), rng.integers(1, 5, 80).astype(float)
    s = n * rng.random(80)
    (feature, cut, left, value), out, _ = cells._grow(bins, [6, 6, 6], n, s, n, 1, 30)
    best = max(((s[m].sum() ** 2 / n[m].sum() + s[~m].sum() ** 2 / n[~m].sum(), f, k) for f in range(3) for k in range(5) if n[m := bins[:, f] <= k].sum() >= 30 and n[~m].sum() >= 30), key=lambda t: t[0])
    assert (feature[0], cut[0]) == best[1:] and list(left) == [1, 0, 0]
    m = bins[:, feature[0]] <= cut[0]
    assert out[m] == pytest.approx(s[m].sum() / n[m].sum()) and value[2] == pytest.approx(s[~m].sum() / n[~m].sum())


def test_boosted_trees_equal_those_of_spark(rows, monkeypatch):
    got, model, _ = learned("hist_gradient_boosting", rows, rounds=6)
    assert isinstance(model, cells.Model)
    monkeypatch.setattr(cells, "CELLS", 50)
    plain, spark_model, _ = learned("hist_gradient_boosting", rows, rounds=6)
    assert not isinstance(spark_model, cells.Model)
    both = got.select("id", "score").join(plain.select("id", F.col("score").alias("other")), "id").collect()
    assert len(both) == 1000 and all(r["score"] == pytest.approx(r["other"], abs=1e-6) for r in both)


def test_network_of_counts(rows, monkeypatch):
    got, model, _ = learned("mlp_classifier", rows, rounds=60)
    assert isinstance(model, cells.Model) and not hasattr(model, "featureImportances")
    monkeypatch.setattr(cells, "CELLS", 50)
    plain, spark_model, _ = learned("mlp_classifier", rows, rounds=60)
    assert not isinstance(spark_model, cells.Model) and ap(got) == pytest.approx(ap(plain), abs=0.03)


def test_least_of_a_valley():
    def loss(p):
        a, b = p
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert cells.lbfgs(loss, np.array([-1.2, 1.0]), 200, 1e-12) == pytest.approx([1, 1], abs=1e-5)


def test_shuffled_counts_keep_both_margins(spark, rows):
    counted = cells.tally(rows, ["u", "z", "label"])
    out = cells.dealt(counted, "u", (1, 2))
    a, b = counted.to_pandas(), out.to_pandas()
    for of in (["u"], ["z", "label"]):
        assert a.groupby(of)["cell_n"].sum().to_dict() == b.groupby(of)["cell_n"].sum().to_dict()
    assert abs(b[b.u >= 5].groupby("label")["cell_n"].sum()[1] / 4000 - (a.cell_n[a.u >= 5].sum() / 4000) * (a.cell_n[a.label == 1].sum() / 4000)) < 0.03


def test_importance_of_counts_and_of_rows(spark, rows, monkeypatch):
    """Alike to within chance; a feature that the score doesn't read has none."""
    predict = lambda d: d.withColumn("score", F.col("u") / 10)
    calls = []
    monkeypatch.setattr(models, "shuffled", lambda *a, f=models.shuffled: calls.append(1) or f(*a))
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(predict, rows, "label", ("u", "y"), ("id",))}
    assert not calls and got["y"] == pytest.approx(0, abs=1e-12)
    monkeypatch.setattr(cells, "CELLS", 50)
    want = {r["feature"]: r["importance"] for r in models.permutation_importance(predict, rows, "label", ("u", "y"), ("id",))}
    assert len(calls) == 10 and got["u"] == pytest.approx(want["u"], abs=0.03) and got["u"] > 0.1
