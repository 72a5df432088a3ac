"""Classifiers and regressors on Spark ML, fitted inside their splits and judged once on held-out rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jobs
from ..functions.stats import finite
from ..schema import CV_FOLDS, DEFAULT, SEED, QualitySchema
from . import cells, evaluate

#: Learned from counts of like rows while those are few, else by Spark ML from rows.
COUNTED = ("random_forest", "hist_gradient_boosting", "mlp_classifier")
MODELS = ("logistic_regression", "random_forest", "hist_gradient_boosting", "mlp_classifier")


def prepare_features(df: DataFrame, roles: QualitySchema = DEFAULT, include_perf: bool = False) -> tuple[list[str], list[str]]:
    """(numeric, categorical) inputs that df has; measured columns and their flags only when asked for."""
    numeric = [c for c in roles.numeric if c in df.columns]
    if include_perf:
        numeric += [c for m in roles.measured for c in (m, f"{m}_was_missing") if c in df.columns]
    return numeric, [c for c in roles.categorical if c in df.columns]


def preprocessed(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]):
    """A function that makes x of any frame, fitted on train alone: median and population z-score, UNKNOWN and full one-hot with unseen levels all zero."""
    got = train.agg(*[F.median(finite(c)).alias(c) for c in numeric]).first() if numeric else {}
    medians = {c: got[c] if got[c] is not None else 0.0 for c in numeric}
    base = lambda df: df.withColumns({f"__{c}": F.coalesce(finite(c), F.lit(medians[c])) for c in numeric} | {f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in categorical})
    stats = base(train).agg(*[F.avg(f"__{c}").alias(f"m:{c}") for c in numeric], *[F.stddev_pop(f"__{c}").alias(f"s:{c}") for c in numeric]).first() if numeric else {}
    scaled = lambda df: base(df).withColumns({f"__{c}": (F.col(f"__{c}") - stats[f"m:{c}"]) / (stats[f"s:{c}"] or 1.0) for c in numeric})
    stages = []
    if categorical:
        stages = [StringIndexer(inputCols=[f"__{c}" for c in categorical], outputCols=[f"__i_{c}" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"__i_{c}" for c in categorical], outputCols=[f"__o_{c}" for c in categorical], dropLast=True)]
    stages.append(VectorAssembler(inputCols=[f"__{c}" for c in numeric] + [f"__o_{c}" for c in categorical], outputCol="x"))
    fitted = Pipeline(stages=stages).fit(scaled(train))
    names = list(numeric)
    if categorical:
        for c, levels in zip(categorical, fitted.stages[0].labelsArray, strict=True):
            names += [f"{c}={v}" for v in levels]

    def make(df: DataFrame) -> DataFrame:
        out = fitted.transform(scaled(df))
        return out.drop(*[c for c in out.columns if c.startswith("__")])

    return make, names


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with weight n / (2 * n_class)."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    weight = F.create_map(*[F.lit(x) for c, m in n.items() for x in (c, sum(n.values()) / (2 * m))])
    return df.withColumn("weight", weight[F.col(label)])


def oversampled(df: DataFrame, label: str, key: Sequence[str], seed: int = SEED) -> tuple[DataFrame, int]:
    """The smaller class repeated to the size of the larger: whole copies, then one more of the first rows by hash. (rows, added)."""
    n = sorted(((r[1], r[0]) for r in df.groupBy(label).count().collect()))
    if len(n) < 2 or n[0][0] == n[1][0]:
        return df, 0
    (few, small), (many, _) = n
    whole, rest = divmod(many, few)
    ranked = evaluate.shares(df.where(F.col(label) == small), label, tuple(key), seed).drop("__n")
    copies = ranked.withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(whole) + (F.col("__i") <= rest).cast("int")))).drop("__c", "__i")
    return df.where(F.col(label) != small).unionByName(copies.select(df.columns)), many - few


def classifier(name: str, n: int, width: int, seed: int = SEED, trees: int = 300, rounds: int = 200):
    common = {"featuresCol": "x", "labelCol": "y"}
    if name == "logistic_regression":
        return LogisticRegression(**common, weightCol="weight", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=2000)
    if name == "random_forest":
        return RandomForestClassifier(**common, weightCol="weight", numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=30, seed=seed)
    if name == "hist_gradient_boosting":
        return GBTClassifier(**common, weightCol="weight", maxIter=rounds, stepSize=0.08, maxBins=255, minInstancesPerNode=20, seed=seed)
    return MultilayerPerceptronClassifier(**common, layers=[width, 32, 16, 2], solver="l-bfgs", maxIter=800 if rounds >= 200 else rounds, seed=seed)


def scored(name: str, train: DataFrame, others: Sequence[DataFrame], label: str, numeric: Sequence[str], categorical: Sequence[str], key: Sequence[str], seed: int = SEED, trees: int = 300, rounds: int = 200):
    """([others with score], fitted model, feature names, make). A single class in train gives a constant score; the network, which takes no weights, gets oversampled rows."""
    make, names = preprocessed(train, numeric, categorical)
    rows = train.where(F.col(label).isin(0, 1))
    classes = [r[0] for r in rows.select(label).distinct().collect()]
    if len(classes) < 2:
        p = float(classes[0]) if classes else 0.0
        return [o.withColumn("score", F.lit(p)) for o in others], None, names, make
    if name == "mlp_classifier":
        rows, _ = oversampled(rows, label, key, seed)
    found = cells.counted(rows, label, [*numeric, *categorical], make) if name in COUNTED else None
    if found is not None:
        model = cells.fitted(rows.sparkSession, classifier(name, int(found[1].sum()), len(names), seed, trees, rounds), *found)
    else:
        data = balanced(make(rows), label).withColumn("y", F.col(label).cast("double"))
        model = classifier(name, rows.count(), len(names), seed, trees, rounds).fit(data)
    return [model.transform(make(o)).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction") for o in others], model, names, make


def importance(model, names: Sequence[str], top: int = 15) -> list[dict]:
    """Native importances, else |coefficient| with its direction; largest first. A network has neither: see permutation_importance."""
    if hasattr(model, "featureImportances"):
        pairs = [(n, float(v), None) for n, v in zip(names, model.featureImportances.toArray(), strict=False)]
    elif hasattr(model, "coefficients"):
        pairs = [(n, abs(float(v)), "raises" if v > 0 else "lowers") for n, v in zip(names, model.coefficients.toArray(), strict=False)]
    else:
        return []
    return [{"feature": n, "importance": v, "direction": d} for n, v, d in sorted(pairs, key=lambda p: (-p[1], p[0]))[:top]]


def shuffled(df: DataFrame, column: str, key: Sequence[str], seed: int) -> DataFrame:
    """df with column dealt out anew: the row at place i by one hash gets the value at place i by another."""
    one = df.withColumn("__g", F.lit(1))
    a = evaluate.shares(one, "__g", tuple(key), seed).drop("__n", "__g", column)
    b = evaluate.shares(one, "__g", tuple(key), seed + 1).select(F.col("__i").alias("__j"), column)
    return a.join(b, F.col("__i") == F.col("__j")).drop("__i", "__j")


def permutation_importance(predict, df: DataFrame, label: str, features: Sequence[str], key: Sequence[str], seed: int = SEED, repeats: int = 5, reads: Sequence[str] = ()) -> list[dict]:
    """Drop of average precision when a feature's values are shuffled; predict adds score, from the features and the columns in reads alone.

    Rows that are alike in those and the label are counted, if there are few such cells: a shuffle of all rows then is a draw of the
    table of cells by values with both margins fixed. Else rows are dealt out by place.
    """
    ap = lambda d, n=None: evaluate.ranking_metrics(predict(d), label, "score", n).first()["average_precision"]
    counted, tries = cells.tally(df, [*dict.fromkeys([*features, *reads]), label]), [(f, r) for f in features for r in range(repeats)]
    base = ap(df) if counted is None else ap(df.sparkSession.createDataFrame(counted), cells.TIMES)

    def drop(t: tuple[str, int]) -> float:
        f, r = t
        dealt = None if counted is None else cells.dealt(counted, f, (seed, r, *f.encode()))
        return base - (ap(shuffled(df, f, key, seed + 2 * r)) if dealt is None else ap(df.sparkSession.createDataFrame(dealt), cells.TIMES))

    got = dict(zip(tries, jobs.each(drop, tries), strict=True))
    out = [{"feature": f, "importance": sum(got[f, r] for r in range(repeats)) / repeats, "direction": None} for f in features]
    return sorted(out, key=lambda r: (-r["importance"], r["feature"]))


def cross_validate(df: DataFrame, label: str, key: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str] = MODELS, k: int = CV_FOLDS, seed: int = SEED, trees: int = 300, rounds: int = 200) -> dict[str, dict]:
    """Per model and measure: mean, population deviation and folds, everything fitted inside each fold."""
    rows, out = evaluate.folds(df, label, tuple(key), seed, k).persist(), {}
    for name in names:
        each: dict[str, list[float]] = {}
        for i in range(k):
            (held,), *_ = scored(name, rows.where(F.col("fold") != i), [rows.where(F.col("fold") == i)], label, numeric, categorical, key, seed, trees, rounds)
            m = evaluate.metrics(held, label, "score", F.col("score") >= 0.5)
            for c in ("average_precision", "roc_auc", "f1", "precision", "recall"):
                each.setdefault(c, []).append(m[c] if m[c] is not None else float("nan"))
        out[name] = {c: {"mean": (a := sum(v) / k), "std": (sum((x - a) ** 2 for x in v) / k) ** 0.5, "folds": v} for c, v in each.items()}
    rows.unpersist()
    return out


def run_modeling(df: DataFrame, roles: QualitySchema = DEFAULT, seed: int = SEED, names: Sequence[str] = MODELS, include_perf: bool = False, cv: bool = True, trees: int = 300, rounds: int = 200, repeats: int = 5, frames: dict[str, DataFrame] | None = None) -> dict:
    """Each model: threshold from validation rows, test rows scored once; the best by validation average precision.

    frames, if given, gets each model's test rows as (unit, label, score).
    """
    numeric, categorical = prepare_features(df, roles, include_perf)
    key = (roles.unit,)
    parts = evaluate.split(df.where(F.col(roles.label).isin(0, 1)), roles.label, key, seed).persist()
    train, val, test = (parts.where(F.col("part") == p) for p in ("train", "validation", "test"))
    out: dict = {"features": [*numeric, *categorical], "sizes": {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}, "models": {}}
    if cv:
        out["cross_validation"] = cross_validate(train, roles.label, key, numeric, categorical, names, seed=seed, trees=trees, rounds=rounds)
    for name in names:
        (v, t), model, features, make = scored(name, train, [val, test], roles.label, numeric, categorical, key, seed, trees, rounds)
        v, t = v.persist(), t.persist()
        cut = evaluate.threshold(v, roles.label, "score")
        hit = F.col("score") >= cut["threshold"]
        found = importance(model, features) if model is not None else []
        if name == "mlp_classifier" and model is not None:
            found = permutation_importance(lambda d, m=model, f=make: m.transform(f(d)).withColumn("score", vector_to_array("probability")[1]), val, roles.label, [*numeric, *categorical], key, seed, repeats)[:15]
        out["models"][name] = {"threshold": cut, "validation": evaluate.metrics(v, roles.label, "score", hit), "test": evaluate.metrics(t, roles.label, "score", hit), "importance": found}
        if frames is not None:
            frames[name] = t.select(*key, roles.label, "score")
        v.unpersist()
        t.unpersist()
    out["best_model"] = max(names, key=lambda m: (out["models"][m]["validation"]["average_precision"] or 0.0, -list(names).index(m)))
    parts.unpersist()
    return out


def ablation(df: DataFrame, name: str, roles: QualitySchema = DEFAULT, seed: int = SEED, trees: int = 300, rounds: int = 200) -> dict:
    """The same model with the measured columns, which are known too late to predict with."""
    got = run_modeling(df, roles, seed, [name], include_perf=True, cv=False, trees=trees, rounds=rounds)
    return {"model": name, "features": got["features"], "test": got["models"][name]["test"]}


def fit_target(df: DataFrame, target: str, roles: QualitySchema = DEFAULT, seed: int = SEED, test: float = 0.2, include_imputed: bool = False, rounds: int = 200, frames: dict[str, DataFrame] | None = None) -> dict:
    """Mean baseline, linear and boosted regression of one measured column; filled-in targets stay out unless asked for.

    frames, if given, gets each model's test rows as (target, prediction).
    """
    rows = df.where(finite(target).isNotNull())
    flag = f"{target}_was_missing"
    if flag in df.columns and not include_imputed:
        rows = rows.where(~F.col(flag))
    n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    if n < 30 or not spread:
        return {"target": target, "n": n, "models": {}, "note": "fewer than 30 rows" if n < 30 else "constant target"}
    numeric, categorical = prepare_features(df, roles)
    parts = evaluate.split(rows.withColumn("__one", F.lit(1)), "__one", (roles.unit,), seed, test, 0.0).persist()
    train, held = parts.where("part <> 'test'"), parts.where("part = 'test'")
    make, _ = preprocessed(train, numeric, categorical)
    data, ready = make(train).persist(), make(held).persist()
    mean = train.agg(F.avg(target)).first()[0]
    judge = lambda d: evaluate.regression_metrics(d, target, "prediction").first().asDict()
    out = {"baseline": judge(ready.withColumn("prediction", F.lit(mean)))}
    for name, model in (("linear_regression", LinearRegression(featuresCol="x", labelCol=target, regParam=0.0)), ("gradient_boosting", GBTRegressor(featuresCol="x", labelCol=target, maxIter=rounds, stepSize=0.08, seed=seed))):
        predicted = model.fit(data).transform(ready)
        out[name] = judge(predicted)
        if frames is not None:
            frames[f"{target}_{name}"] = predicted.select(target, "prediction")
        out[name]["mae_reduction_vs_baseline_pct"] = 100 * (1 - out[name]["mae"] / out["baseline"]["mae"]) if out["baseline"]["mae"] else None
    for d in (parts, data, ready):
        d.unpersist()
    best = min(("linear_regression", "gradient_boosting"), key=lambda m: out[m]["mae"])
    return {"target": target, "n": n, "models": out, "best": best, "beats_baseline": out[best]["mae"] < out["baseline"]["mae"], "note": None}


def run_regression(df: DataFrame, roles: QualitySchema = DEFAULT, seed: int = SEED, **given) -> dict:
    found = [fit_target(df, t, roles, seed, **given) for t in roles.measured if t in df.columns]
    return {"primary": found[0] if found else None, "others": found[1:], "note": None if found else "no measured column"}

