"""Splits, metrics and thresholds, by aggregates over distinct scores rather than over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prefix
from ..schema import CV_FOLDS, SEED, TEST_SHARE, VALIDATION_SHARE


def _hashed(seed: int, key: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit(seed), *key)


def shares(df: DataFrame, label: str, key: tuple[str, ...], seed: int, salt: int = 4_096) -> DataFrame:
    """df with __i, the place of a row in its class in an order by hash, and __n, the class's size. Places come from hash ranges, so no task holds a class."""
    h = _hashed(seed, key)
    rows = df.withColumn("__h", h).withColumn("__g", F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * salt).cast("int"))
    inside = Window.partitionBy(label, "__g").orderBy("__h", *key)
    totals = rows.groupBy(label, "__g").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(label).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(label).alias("__l"), F.col("__g").alias("__gg"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"), F.sum("__c").over(Window.partitionBy(label)).alias("__n"))
    out = rows.withColumn("__r", F.row_number().over(inside)).join(F.broadcast(totals), F.col(label).eqNullSafe(F.col("__l")) & (F.col("__g") == F.col("__gg")))
    return out.withColumn("__i", F.col("__r") + F.col("__b")).drop("__h", "__g", "__gg", "__l", "__r", "__b")


def split(df: DataFrame, label: str, key: tuple[str, ...], seed: int = SEED, test: float = TEST_SHARE, validation: float = VALIDATION_SHARE) -> DataFrame:
    """df with part: test is the first share of each class by hash, validation the share of what is left, train the rest."""
    rows = shares(df, label, key, seed)
    n_test = F.bround(F.col("__n") * test)
    n_val = F.bround((F.col("__n") - n_test) * validation)
    return rows.withColumn("part", F.when(F.col("__i") <= n_test, "test").when(F.col("__i") <= n_test + n_val, "validation").otherwise("train")).drop("__i", "__n")


def folds(df: DataFrame, label: str, key: tuple[str, ...], seed: int = SEED, k: int = CV_FOLDS) -> DataFrame:
    return shares(df, label, key, seed).withColumn("fold", (F.col("__i") % k).cast("int")).drop("__i", "__n")


def curve(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """Per distinct score: pos and neg rows at it, and tp, fp: the rows at or above it. weight: how many rows a row stands for."""
    ok = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    n = lambda y: F.coalesce(F.sum(F.when(F.col(label) == y, F.col(weight))), F.lit(0)) if weight else F.count_if(F.col(label) == y)
    hist = ok.groupBy((-F.col(score).cast("double")).alias("__s")).agg(n(1).alias("pos"), n(0).alias("neg")).withColumn("__g", F.lit(1))
    run = prefix.running(hist, ["__g"], "__s", ["pos", "neg"])
    return run.select((-F.col("__s")).alias("score"), "pos", "neg", (F.col("pos__before") + F.col("pos")).alias("tp"), (F.col("neg__before") + F.col("neg")).alias("fp"))


def ranking_metrics(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """n_pos, n_neg, average_precision (steps, no trapezoids), roc_auc (ties averaged), brier; null where a class is missing."""
    c = curve(df, label, score, weight)
    p = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    loss = F.col("pos") * (1 - F.col("score")) * (1 - F.col("score")) + F.col("neg") * F.col("score") * F.col("score")
    got = c.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.sum(p).alias("p"), F.sum(area).alias("a"), F.sum(loss).alias("l"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return got.select("n_pos", "n_neg", F.when(both, F.col("p") / F.col("n_pos")).alias("average_precision"), F.when(both, F.col("a") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"), F.when(both, F.col("l") / (F.col("n_pos") + F.col("n_neg"))).alias("brier"))


def confusion(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """tn, fp, fn, tp and what follows from them; ratios over nothing are 0, balanced accuracy is null with one class."""
    ok = df.where(F.col(label).isin(0, 1)).select(F.col(label).alias("y"), predicted.cast("int").alias("p"))
    got = ok.agg(*[F.count_if((F.col("y") == y) & (F.col("p") == p)).alias(name) for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = got.withColumns({"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "specificity": over(tn, tn + fp), "accuracy": over(tp + tn, tp + tn + fp + fn)})
    out = out.withColumn("f1", over(2 * tp, 2 * tp + fp + fn))
    return out.withColumn("balanced_accuracy", F.when((tp + fn > 0) & (tn + fp > 0), (F.col("recall") + F.col("specificity")) / 2))


def metrics(df: DataFrame, label: str, score: str | None, predicted: Column) -> dict:
    """All of compute: counts, confusion, ratios, ranking metrics."""
    c = confusion(df, label, predicted).first().asDict()
    n_pos, n_neg = c["tp"] + c["fn"], c["tn"] + c["fp"]
    n = n_pos + n_neg
    r = ranking_metrics(df, label, score).first().asDict() if score else {"average_precision": None, "roc_auc": None, "brier": None}
    ratios = {k: c[k] if n else None for k in ("precision", "recall", "f1", "accuracy", "specificity", "balanced_accuracy")}
    return {"n": n, "n_positive": n_pos, "n_negative": n_neg, "positive_rate": n_pos / n if n else None, "single_class": not (n_pos and n_neg), "no_positive_prediction": not (c["tp"] + c["fp"]), "confusion_matrix": [[c["tn"], c["fp"]], [c["fn"], c["tp"]]]} | ratios | {k: r[k] for k in ("average_precision", "roc_auc", "brier")}


def threshold(df: DataFrame, label: str, score: str, metric: str = "f1") -> dict:
    """The score at which predicting positive from there up is best; the smallest on ties; 0.5 with one class."""
    c = curve(df, label, score)
    total = c.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n")).first()
    if not total["p"] or not total["n"]:
        return {"threshold": 0.5, "score": None, "metric": metric, "note": "a single class"}
    f1 = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + total["p"])
    best = c.withColumn("m", f1 if metric == "f1" else F.col("tp") / (F.col("tp") + F.col("fp"))).orderBy(F.desc("m"), "score").limit(1).first()
    return {"threshold": best["score"], "score": best["m"], "metric": metric, "note": None}


def regression_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """n, mae, rmse, r2 (null for a constant target), target_mean, target_std over complete finite pairs; one aggregate."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    ok = df.where(fine(y) & fine(predicted)).select(F.col(y).cast("double").alias("y"), (F.col(predicted).cast("double") - F.col(y)).alias("e"))
    got = ok.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg("y").alias("target_mean"), F.stddev_pop("y").alias("target_std"))
    return got.select("n", "mae", F.sqrt("mse").alias("rmse"), F.when(F.col("target_std") > 0, 1 - F.col("mse") / (F.col("target_std") * F.col("target_std"))).alias("r2"), "target_mean", "target_std")
