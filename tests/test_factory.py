"""The made-up factory: counts of planted defects, effects that the screening finds, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from lodestat import cli
from lodestat.operators import integrate, models, significance
from lodestat.plans import report
from lodestat.sources import synth, tables


@pytest.fixture(scope="module")
def made(spark):
    raw, manifest = synth.generate_all(spark)
    return {k: v.cache() for k, v in raw.items()}, manifest


@pytest.fixture(scope="module")
def wide(made):
    return integrate.build_analysis_table(made[0]).cache()


def test_planted_defects(made):
    raw, manifest = made
    assert raw["material_batches"].count() == 36 and raw["production_runs"].count() == 144
    runs, units = raw["production_runs"], raw["inspection_results"]
    assert runs.where("furnace_temp_c = 9999").count() == 3 and runs.where("machine_id is null").count() == 3
    assert units.count() - units.dropDuplicates().count() == 2
    assert units.select("plant_code").distinct().count() == 1 and 0.08 < units.agg(F.avg("is_fail")).first()[0] < 0.25
    assert raw["perf_tests"].where("tensile_strength_mpa < 300").count() >= 6
    assert set(manifest["ground_truth_mechanism"]) == {"primary", "secondary", "indirect", "decoy"}


def test_same_whatever_the_partitioning(spark, made):
    again, _ = synth.generate_all(spark)
    assert tables.fingerprint(again["inspection_results"].repartition(9)) == tables.fingerprint(made[0]["inspection_results"])
    other, _ = synth.generate_all(spark, 7)
    assert tables.fingerprint(other["inspection_results"]) != tables.fingerprint(made[0]["inspection_results"])


def test_no_fanout(made, wide):
    assert wide.count() == made[0]["inspection_results"].count() and len(wide.columns) == 28


def test_roundtrip(spark, made, tmp_path):
    path = f"file://{tmp_path}/data"
    with pytest.raises(FileNotFoundError):
        tables.load_raw_tables(spark, path)
    tables.save_raw_tables(made[0], path)
    back = tables.load_raw_tables(spark, path)
    for name, df in made[0].items():
        assert back[name].dtypes == df.dtypes and back[name].count() == df.count()
        assert back[name].exceptAll(df).count() == 0


def test_screening_finds_the_causes(made, wide):
    clean, _ = integrate.clean(wide)
    clean = clean.cache()
    tests = significance.screen_factors(clean, integrate.build_run_level_table(clean), integrate.build_batch_level_table(clean), n_perm=100, information=False)
    ranking = significance.rank_factors(tests).cache()
    found = significance.significant_factors(ranking)
    assert {"furnace_temp_c", "pressure_mpa", "material_moisture_pct"} <= set(found)
    assert not {"ambient_humidity_pct", "operator_id", "material_particle_size_um"} & set(found)
    assert significance.significant_factors(ranking, "unknown") == []
    rows = {r["factor"]: r for r in ranking.collect()}
    assert rows["operator_id"]["naive_significant"] and rows["operator_id"]["verdict"].startswith("pseudo-replication")


def test_numbers_as_text():
    assert report.fmt(None) == "n/a" and report.fmt(1.23456) == "1.2346" and report.fmt_p(0) == "<1e-300" and report.fmt_p(1e-5) == "1.00e-05"
    assert report.table(["a"], [["x|y"]]).splitlines()[2] == "| x\\|y |"


def test_cli(capsys):
    assert cli.main(["info"]) == 0 and "lodestat" in capsys.readouterr().out
    args = cli.parser().parse_args(["run", "--out", "x", "--n-perm", "5", "--no-plots"])
    assert args.out == "x" and args.n_perm == 5 and args.no_plots


def test_all_checks_find_what_was_planted(made, wide):
    from lodestat.operators import quality

    report_ = quality.run_quality_checks(wide, perf=made[0]["perf_tests"])
    got = quality.summarize_quality(report_)
    assert got["constant_columns"] == ["plant_code"] and got["near_constant_columns"] == ["is_archived"] and got["full_duplicate_rows"] == 2
    assert got["out_of_range_values"] > 0 and got["class_balance"] == "moderate" and report_["perf_fanout"]["fanout_detected"] and report_["perf_fanout"]["max"] >= 2


def test_series_of_the_factory(wide):
    from lodestat.plans import pipeline

    clean, _ = integrate.clean(wide)
    got = pipeline.run_timeseries(clean, values=("tensile_strength_mpa",))
    assert got["batch_fail_rate"]["n"] == 36 and got["run_fail_rate"]["n"] == 144 and len(got["batch_fail_rate"]["backtest"]) == 4
    assert pipeline.run_timeseries(clean.drop("batch_id"))["note"].startswith("cannot analyze")
    assert pipeline.run_timeseries(clean.where("batch_id = 'B01'"))["note"] == "series too short"


def test_more_batches_than_two_digits(spark):
    batches = synth.material_batches(spark, batches=120)
    runs = synth.production_runs(batches, runs_per_batch=10)
    assert batches.select("batch_id").distinct().count() == 120 and runs.select("run_id").distinct().count() == 1200
    assert {"B01", "B99", "B100"} <= {r["batch_id"] for r in batches.collect()}


def test_the_manifest_is_read_again(spark, tmp_path):
    _, first, made = synth.ensure_raw_data(spark, f"file://{tmp_path}/d")
    raw, second, again = synth.ensure_raw_data(spark, f"file://{tmp_path}/d")
    assert made and not again and first == second and second["ground_truth_mechanism"]["primary"]


def test_arguments_without_a_command(monkeypatch):
    seen = {}
    monkeypatch.setattr(cli, "session", lambda: None)
    monkeypatch.setattr(cli.pipeline, "run_pipeline", lambda spark, out, *rest, **more: seen.update(out=out))
    monkeypatch.setattr("sys.argv", ["lodestat", "--out", "there", "--n-perm", "9"])
    assert cli.main() == 0 and seen == {"out": "there"}
    assert cli.main(["--out", "here"]) == 0 and seen == {"out": "here"}


def test_info_tells_the_settings():
    assert "seed: 20240617" in cli.info() and "furnace_temp_c: 1420.0 to 1580.0" in cli.info()


def test_frames_of_the_figures(spark, wide):
    from lodestat.plans import plotdata
    from lodestat.schema import DEFAULT

    clean, _ = integrate.clean(wide)
    clean = clean.cache()
    scored, predicted = {}, {}
    got = models.run_modeling(clean, names=["logistic_regression"], cv=False, frames=scored)
    drawn = plotdata.model_catalog(got, scored, DEFAULT)
    cells, test = drawn["confusion"].first(), got["models"]["logistic_regression"]["test"]
    assert cells["model"] == "logistic_regression" and sum(cells[c] for c in ("tn", "fp", "fn", "tp")) == test["n"]
    assert cells["tp"] / (cells["tp"] + cells["fn"]) == pytest.approx(test["recall"]) and cells["tp"] / (cells["tp"] + cells["fp"]) == pytest.approx(test["precision"])
    last = drawn["model_curves"].orderBy("score").first()
    assert last["recall"] == 1 and last["false_positive_rate"] == 1
    target = DEFAULT.measured[0]
    found = models.fit_target(clean, target, rounds=2, frames=predicted)
    grids = plotdata.regression_catalog(predicted, target)
    assert len(grids) == 2 and all(df.agg(F.sum("n")).first()[0] == found["models"][name.removeprefix(f"actual_{target}_")]["n"] for name, df in grids.items())
