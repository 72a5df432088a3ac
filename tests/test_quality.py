import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestat.operators import integrate, quality
from lodestat.schema import QualitySchema

TOY = "run_id string, batch_id string, start_time timestamp_ntz, temp double, pressure double, empty double, cat string, single string, is_fail int"


@pytest.fixture(scope="module")
def toy(spark):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([("R1", "B1", t, 1500.0, 3.0, None, "a", "X", 0), ("R2", "B1", t, 1510.0, None, None, "b", "X", 1), ("R3", "B2", t, 1490.0, 3.2, None, "a", "X", 0), ("R4", "B2", t, 1505.0, 3.1, None, "b", "X", 0)], TOY)


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_missing(toy):
    got = rows(quality.missing_by_column(toy), "column")
    assert got["pressure"]["n_missing"] == 1 and got["empty"]["all_missing"] and got["empty"]["pct"] == 100.0
    assert {r["n_missing"]: r["n_rows"] for r in quality.missing_by_row(toy).collect()} == {1: 3, 2: 1}


def test_missing_of_nothing(toy):
    got = rows(quality.missing_by_column(toy.where("false")), "column")
    assert got["empty"]["n_missing"] == 0 and not got["empty"]["all_missing"]
    assert quality.missing_by_row(toy.where("false")).count() == 0


def test_duplicates(toy):
    got = rows(quality.duplicates(toy.unionByName(toy.where("run_id = 'R1'")), ["run_id"]), "what")
    assert got["(row)"]["n_beyond_first"] == 1 and got["run_id"]["n_unique"] == 4 and not got["run_id"]["is_unique"]


def test_constants(spark, toy):
    got = rows(quality.constant_columns(toy), "column")
    assert got["single"]["is_constant"] and got["single"]["top_value"] == "X" and got["single"]["n_valid"] == 4
    assert got["empty"]["is_constant"] and got["empty"]["top_value"] is None
    for a, b, near in ((90, 10, False), (199, 1, True)):
        df = spark.createDataFrame([("A",)] * a + [("B",)] * b, "x string")
        assert quality.constant_columns(df).first()["is_near_constant"] is near


def test_out_of_range(spark):
    df = spark.createDataFrame(list(enumerate([1500.0, 1400.0, 1600.0, 1505.0])), "i int, furnace_temp_c double")
    got = quality.out_of_range(df, {"furnace_temp_c": (1420.0, 1580.0), "absent": (0, 1)}, "i").collect()
    assert len(got) == 1 and (got[0]["n_below"], got[0]["n_above"], got[0]["n_out_of_range"], got[0]["first_example"]) == (1, 1, 2, 1400.0)


def test_class_balance(spark):
    for pos, neg, severity in ((12, 88, "moderate"), (50, 50, "balanced"), (3, 97, "severe"), (0, 5, "degenerate"), (0, 0, "empty")):
        df = spark.createDataFrame([(1,)] * pos + [(0,)] * neg + [(None,)], "y int")
        r = quality.class_balance(df, "y").first()
        assert r["severity"] == severity and r["n"] == pos + neg
    assert quality.class_balance(spark.createDataFrame([(1,)] * 12 + [(0,)] * 88, "y int"), "y").first()["neg_pos_ratio"] == pytest.approx(7.3333, abs=1e-4)


def test_dtype_issues(spark):
    df = spark.createDataFrame([("1500",), ("3.2MPa",), (None,), ("1480",), ("1.0d",)], "x string")
    r = quality.dtype_issues(df, ["x", "absent"]).first()
    assert r["n_unparsable"] == 2 and r["example"] == "1.0d"


def test_drift(spark):
    from pyspark.sql.functions import expr

    base = spark.range(6000).select((F.col("id") < 3000).alias("b"), expr("sqrt(-2*ln((pmod(xxhash64(id),1000003)+0.5)/1000003D))*cos(2*pi()*(pmod(xxhash64(id,1),1000003)+0.5)/1000003D)").alias("n"))
    for shift, drifted in ((0.03, False), (2.0, True)):
        got = quality.drift_report(base.withColumn("x", F.col("n") + F.when(F.col("b"), 0.0).otherwise(shift)), ["x"], "b")
        assert got[0]["drifted"] is drifted
    flat = quality.psi(quality.long(base.withColumn("x", F.lit(1.0)), ["x"], "b"), "b").first()
    assert flat["psi"] is None


def test_baseline(spark):
    df = spark.createDataFrame([(f"R{i}", dt.datetime(2025, 1, 1 + i)) for i in range(8)], "run_id string, start_time timestamp_ntz")
    got = {r["run_id"] for r in quality.baseline_keys(df, "run_id", "start_time").where("is_baseline").collect()}
    assert got == {"R0", "R1"}


def test_fanout(spark):
    df = spark.createDataFrame([("U1",), ("U1",), ("U2",)], "unit_id string")
    assert quality.fanout_summary(df, "unit_id")["max"] == 2
    assert quality.fanout_summary(df, "absent") == {"present": False}


def test_aggregate_child(spark):
    df = spark.createDataFrame([("U1", 440.0), ("U1", 460.0), ("U2", 430.0), ("U2", None), (None, 1.0)], "unit_id string, tensile double")
    got = rows(integrate.aggregate_child(df, "unit_id", ["tensile", "absent"], "n"), "unit_id")
    assert got["U1"]["tensile"] == 450 and got["U1"]["n"] == 2 and got["U2"]["tensile"] == 430 and got["U2"]["n"] == 2 and len(got) == 2


def test_join_checks_cardinality(spark):
    left = spark.createDataFrame([("a",)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(integrate.CardinalityError):
        integrate.many_to_one(left, right, "k")


def test_clean(spark):
    roles = QualitySchema(label="y", run_numeric=("x",), batch_numeric=(), run_categorical=("c",), batch_categorical=(), measured=("t",))
    df = spark.createDataFrame([(1, 5.0, "a", 1.0, 0), (1, 5.0, "a", 1.0, 0), (2, 99.0, None, None, 1), (3, 7.0, "b", 3.0, None)], "i int, x double, c string, t double, y int")
    out, did = integrate.clean(df, roles, {"x": (0.0, 10.0)})
    got = rows(out, "i")
    assert set(got) == {1, 2} and got[2]["x"] == 6.0 and got[2]["c"] == "UNKNOWN" and got[2]["t"] == 2.0 and got[2]["t_was_missing"] and not got[1]["t_was_missing"]
    assert did["exact_duplicate_rows_dropped"] == 1 and did["out_of_range_to_nan"] == {"x": 1} and did["rows_dropped_missing_label"] == 1 and did["rows_final"] == 2


def test_baseline_by_the_times_own_type(spark):
    df = spark.createDataFrame([(f"R{i}", i) for i in range(1, 13)], "run_id string, start_time int")
    got = {r["run_id"] for r in quality.baseline_keys(df, "run_id", "start_time").where("is_baseline").collect()}
    assert got == {"R1", "R2", "R3"}


def test_baseline_without_times_and_by_batch(spark):
    df = spark.createDataFrame([("R1", "B02", 1.0), ("R2", "B01", 2.0), (None, None, 3.0)], "run_id string, batch_id string, x double")
    marked, info = quality.baseline(df)
    assert {r["run_id"]: r["is_baseline"] for r in marked.collect()} == {"R1": False, "R2": True, None: False} and info["method"] == "first batches by name"
    marked, info = quality.baseline(df, batch="B02")
    assert {r["run_id"]: r["is_baseline"] for r in marked.collect()} == {"R1": True, "R2": False, None: False} and info == {"method": "batch", "batch": "B02"}
    timed = df.withColumn("start_time", df["x"])
    assert quality.baseline(timed)[0].count() == 3, "rows without a run stay"


def test_three_examples(spark):
    df = spark.createDataFrame([(v,) for v in ("1", "b x", "a?", "d", "c-", "a?", None)], "x string")
    r = quality.dtype_issues(df, ["x"]).first()
    assert r["n_unparsable"] == 5 and r["example"] == "a?" and r["examples"] == ["a?", "b x", "c-"]


def test_measures_from_counts_equal_numpy(spark):
    import numpy as np

    from lodestat.functions import prefix

    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 400).round(1), rng.normal(0.7, 1, 300).round(1)
    rows = [("x", float(v), True) for v in a] + [("x", float(v), False) for v in b] + [("x", float("-inf"), True), ("x", None, True), ("x", float("nan"), False)]
    flat = spark.createDataFrame(rows, "column string, value double, side boolean")
    got = quality.ks_statistic(flat, "side").first()
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert (got["n1"], got["n2"]) == (400, 300) and got["ks"] == pytest.approx(want)

    counts = spark.createDataFrame([(k, float(v)) for k, vs in (("a", a), ("b", b)) for v in vs], "k string, v double").groupBy("k", "v").count()
    at = [0, 0.1, 0.25, 0.5, 0.9, 1]
    q = {r["k"]: r for r in prefix.quantiles(prefix.running(counts, ["k"], "v", ["count"], cuts=7), ["k"], "v", "count", at).collect()}
    for k, vs in (("a", a), ("b", b)):
        assert q[k]["total"] == len(vs) and q[k]["q"] == pytest.approx(list(np.quantile(vs, at)))


def test_cleaning_by_hand(spark):
    from lodestat.operators import integrate
    from lodestat.schema import QualitySchema

    roles = QualitySchema(label="y", unit="u", run="r", batch="b", run_numeric=("a",), batch_numeric=(), run_categorical=("c",), batch_categorical=(), measured=("m",), limits={"a": (0.0, 10.0)})
    rows = [(1, 1, 2.0, "k", 5.0), (1, 1, 2.0, "k", 5.0), (2, 0, 99.0, None, None), (3, None, 4.0, "k", 7.0), (4, 1, 5.0, "k", float("nan")), (5, 0, None, "k", 6.0)]
    out, said = integrate.clean(spark.createDataFrame(rows, "u int, y int, a double, c string, m double"), roles)
    assert (said["rows_before"], said["exact_duplicate_rows_dropped"], said["rows_dropped_missing_label"], said["rows_final"]) == (6, 1, 1, 4)
    assert said["out_of_range_to_nan"] == {"a": 1} and said["categorical_filled_unknown"] == ["c"] and said["numeric_median_imputed"]["a"] == 4.0
    got = {r["u"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 4, 5] and got[2]["a"] == 4.0 and got[5]["a"] == 4.0 and got[2]["c"] == "UNKNOWN" and got[2]["m_was_missing"]
    empty, none = integrate.clean(spark.createDataFrame([], "u int, y int, a double, c string, m double"), roles)
    assert empty.count() == 0 and none["rows_before"] == 0 and none["numeric_median_imputed"] == {}
