"""Numbers as text, Markdown tables and the report."""

from __future__ import annotations

import platform
import sys
from datetime import UTC, datetime

from ..sources.tables import write_json


def fmt(value, digits: int = 4, na: str = "n/a") -> str:
    if value is None or (isinstance(value, float) and value != value):
        return na
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def fmt_p(value) -> str:
    if value is None or value != value:
        return "n/a"
    return "<1e-300" if value == 0 else f"{value:.2e}" if value < 1e-4 else f"{value:.4f}"


def table(headers: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)])


def write_run_meta(path: str, elapsed: dict[str, float], seed: int, spark=None, **extra) -> str:
    """What varies from run to run, kept apart from the metrics."""
    import pyspark

    return write_json({"finished_utc": datetime.now(UTC).isoformat(), "python": sys.version.split()[0], "pyspark": pyspark.__version__, "platform": platform.platform(), "seed": seed, "elapsed_seconds": {k: round(v, 4) for k, v in elapsed.items()}} | extra, path, spark)


def markdown(m: dict) -> str:
    """The report, from the metrics alone."""
    q, out = m["quality_summary"], ["# Quality report", ""]
    add = lambda title, *body: out.extend([f"## {title}", "", *body, ""])
    add("1. Data", table(["table", "rows"], [[k, v] for k, v in m["rows"].items()]))
    add("2. Data quality", table(["finding", "value"], [[k, fmt(v)] for k, v in q.items()]))
    add("3. Cleaning", table(["step", "value"], [[k, v] for k, v in m["cleaning"].items()]))
    add("4. Class balance", str(q["class_balance"]))
    add("5. Factors", table(["rank", "factor", "level p", "level q", "cluster p", "naive p", "verdict"], [[r["rank"], r["factor"], fmt_p(r["factor_p"]), fmt_p(r["factor_q"]), fmt_p(r["cluster_p"]), fmt_p(r["naive_p"]), r["verdict"]] for r in m["ranking"]]))
    pseudo = [r["factor"] for r in m["ranking"] if r["naive_significant"] and not r["factor_significant"] and not r["cluster_significant"]]
    add("6. False positives of unit-level tests", ", ".join(pseudo) or "none", "", "Significant if units were independent, at neither valid level.")
    models = m.get("modeling") or {"models": {}}
    add("7. Classification", table(["model", "threshold", "AP", "AUC", "precision", "recall", "F1"], [[n, fmt(r["threshold"]["threshold"], 3), *[fmt(r["test"][c]) for c in ("average_precision", "roc_auc", "precision", "recall", "f1")]] for n, r in models["models"].items()]), "", "Classes are weighted, for the network oversampled. Thresholds come from validation rows.")
    c = m.get("clustering") or {}
    add("8. Failure modes", table(["k", "silhouette", "inertia", "Calinski-Harabasz", "Davies-Bouldin"], [[r["k"], *[fmt(r[x]) for x in ("silhouette", "inertia", "calinski_harabasz", "davies_bouldin")]] for r in c.get("k_selection", [])]), "", f"Chosen k: {c.get('best_k')}. {c.get('note') or ''}")
    r = m.get("regression") or {}
    rows = [[t["target"], n, *[fmt(v[x]) for x in ("mae", "rmse", "r2")]] for t in [r.get("primary"), *(r.get("others") or [])] if t for n, v in t["models"].items()]
    add("9. Measured properties", table(["target", "model", "MAE", "RMSE", "R2"], rows))
    s = m.get("series") or {}
    add("10. Trends over time", table(["series", "n", "MK p", "Sen slope", "r1", "best forecast", "state"], [[n, v["n"], fmt_p(v["mann_kendall"]["p_value"]), fmt(v["mann_kendall"]["sen_slope"], 6), fmt(v["lag1"]["r1"]), v["best"], v["state"]] for n, v in s.items()]))
    add("11. Notes", "All random choices are hashes of keys and the seed.")
    return "\n".join(out)
