"""Command line: run, stability, info."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .operators import integrate, significance
from .plans import checks, pipeline, report
from .schema import N_PERM, SEED
from .session import session
from .sources import synth, tables


COMMANDS = ("run", "stability", "info", "reproduce", "calibrate")


def info() -> str:
    """Versions and the settings that every run starts from."""
    import pyspark

    from . import schema

    names = ("SEED", "ALPHA", "N_PERM", "CV_FOLDS", "TEST_SHARE", "VALIDATION_SHARE", "DRIFT_BINS", "DRIFT_PSI", "DRIFT_KS_STATISTIC", "BASELINE_SHARE", "NEAR_CONSTANT")
    lines = [f"lodestat {__version__}, pyspark {pyspark.__version__}, python {sys.version.split()[0]}", *[f"{n.lower()}: {getattr(schema, n)}" for n in names]]
    return "\n".join([*lines, *[f"{c}: {lo} to {hi}" for c, (lo, hi) in schema.LIMITS.items()]])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestat")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")
    run = sub.add_parser("run", help="the whole analysis")
    run.add_argument("--out", default="out")
    run.add_argument("--data-dir", default="data")
    run.add_argument("--seed", type=int, default=SEED)
    run.add_argument("--regenerate-data", action="store_true")
    run.add_argument("--no-plots", action="store_true")
    run.add_argument("--n-perm", type=int, default=N_PERM)
    run.add_argument("--quiet", action="store_true")
    run.add_argument("--light", action="store_true", help="fewer trees and rounds, no cross-validation")
    stable = sub.add_parser("stability", help="how often each factor is found over several seeds")
    stable.add_argument("--seeds", type=int, default=5)
    stable.add_argument("--out", default="out")
    stable.add_argument("--n-perm", type=int, default=200)
    sub.add_parser("info", help="versions and settings")
    again = sub.add_parser("reproduce", help="two runs, the second on the tables that the first wrote, compared file by file")
    again.add_argument("--out", default="out")
    again.add_argument("--n-perm", type=int, default=200)
    again.add_argument("--light", action="store_true")
    tuned = sub.add_parser("calibrate", help="whether the made-up factory's causes can be found, and its figures")
    tuned.add_argument("--seeds", type=int, default=5)
    tuned.add_argument("--out", default="out")
    tuned.add_argument("--n-perm", type=int, default=300)
    return p


def ranking_of(spark, seed: int, n_perm: int):
    raw, _ = synth.generate_all(spark, seed)
    clean, _ = integrate.clean(integrate.build_analysis_table(raw))
    clean = clean.persist()
    tests = significance.screen_factors(clean, integrate.build_run_level_table(clean), integrate.build_batch_level_table(clean), seed=seed, n_perm=n_perm, information=False)
    return significance.rank_factors(tests)


def stability(spark, seeds: list[int], n_perm: int) -> dict:
    rows = [r.asDict() for r in significance.stability(lambda s: ranking_of(spark, s, n_perm), seeds).orderBy("factor").collect()]
    truth, by = synth.ground_truth(), {r["factor"]: r for r in rows}
    return {"seeds": seeds, "factors": rows, "primary_recovery": {f: by[f]["own"] for f in truth["primary"] if f in by}, "decoy_false_positives": {f: by[f]["own"] for f in truth["decoy"] if f in by}}


def main(argv: list[str] | None = None) -> int:
    given, p = sys.argv[1:] if argv is None else list(argv), parser()
    # without a command the arguments are those of run
    first = next((a for a in given if not a.startswith("-")), None)
    args = p.parse_args(given if first in COMMANDS or {*given} & {"-h", "--help", "--version"} else ["run", *given])
    if args.command == "info":
        print(info())
        return 0
    spark = session()
    if args.command == "stability":
        got = stability(spark, [SEED + i for i in range(args.seeds)], args.n_perm)
        tables.write_json(got, f"{args.out}/stability.json", spark)
        print(report.table(["factor", "naive", "cluster", "own level"], [[r["factor"], r["naive"], r["cluster"], r["own"]] for r in got["factors"]]))
        return 0
    if args.command == "reproduce":
        got = checks.reproducibility(spark, args.out, args.n_perm, args.light)
        print(report.table(["file", "same"], [[name, same] for name, same in got["files"].items()]))
        return 0 if got["same"] else 1
    if args.command == "calibrate":
        got = checks.calibration(spark, [SEED + 1000 * i for i in range(args.seeds)], args.n_perm, ranking_of)
        tables.write_json(got, f"{args.out}/calibration.json", spark)
        print(report.table(["group", "factor", "naive", "cluster", "own level"], [[r["group"], r["factor"], r["naive"], r["cluster"], r["own"]] for r in got["factors"]]))
        return 0
    pipeline.run_pipeline(spark, args.out, args.data_dir, args.seed, args.regenerate_data, args.n_perm, not args.no_plots, log=(lambda _: None) if args.quiet else print, light=args.light)
    return 0
