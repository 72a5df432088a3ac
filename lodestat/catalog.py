"""Query registry: one entry per operator, its Spark plan beside the equal DuckDB SQL.

The operators run on the driver's star schema: a lineitem is a unit that fails
if it was returned, suppliers are runs, nations batches, orders have many lines,
and months of order dates make series. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import special, stats
from .operators import cluster, evaluate, integrate, models, quality, series, significance
from .plans import plotdata
from .schema import QualitySchema

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, the same way in both engines, whose round() differ. Spark's floor() is a long: from 2^53 on, where doubles are whole, the number stands for itself."""

    def one(x: Column) -> Column:
        y = x * 1e6 + 0.5
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) / 1e6

    return df.select(*[one(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def _query(sql: str | None = None, doubles: str = "", others: str = ""):
    """Register a function as the query of its name, with the SQL for its oracle; doubles and others name the columns of the result."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            columns = [f'CAST(floor("{c}" * 1e6 + 0.5) / 1e6 AS DOUBLE) AS "{c}"' for c in doubles.split()] + [f'"{c}"' for c in others.split()]
            _oracles[f.__name__] = f"WITH result_ AS ({sql}) SELECT {', '.join(columns)} FROM result_"
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views that both engines make alike -------------------------------------

_DIRTY = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_quantity END AS quantity,
 CASE WHEN l_orderkey % 211 = 0 THEN CAST(9999.0 AS DOUBLE) ELSE l_discount END AS discount, 'P1' AS plant, l_orderkey % 251 = 0 AS archived,
 CASE WHEN l_orderkey % 307 = 0 THEN '3.2MPa' ELSE CAST(l_linenumber AS VARCHAR(9)) END AS reading, l_returnflag, l_extendedprice FROM lineitem"""
_DIRTY_SQL = f"({_DIRTY} UNION ALL {_DIRTY} WHERE l_orderkey % 499 = 0)"
_UNITS_SQL = """(SELECT l_orderkey, l_linenumber, l_suppkey, s_nationkey, n_regionkey, CAST(l_returnflag = 'R' AS INT) AS is_fail, l_quantity, l_discount, l_tax, l_extendedprice,
 l_linestatus, s_acctbal, (l_quantity + 100 * l_discount) / 60 AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
_MONTHS_SQL = """(SELECT strftime(o_orderdate, '%Y-%m') AS key, avg(CAST(o_orderpriority = '1-URGENT' AS INT)) AS value, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m')) - 1 AS pos,
 count(*) AS n_units FROM orders GROUP BY 1)"""


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    one = line.select(
        "l_orderkey", "l_linenumber", F.when(k % 97 != 0, F.col("l_quantity")).alias("quantity"), F.when(k % 211 == 0, 9999.0).otherwise(F.col("l_discount")).alias("discount"),
        F.lit("P1").alias("plant"), (k % 251 == 0).alias("archived"), F.when(k % 307 == 0, "3.2MPa").otherwise(F.col("l_linenumber").cast("string")).alias("reading"), "l_returnflag", "l_extendedprice",
    )
    return one.unionByName(one.where("l_orderkey % 499 = 0"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier, nation = (_table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)  # nation: 25 rows
    return rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "s_nationkey", "n_regionkey", (F.col("l_returnflag") == "R").cast("int").alias("is_fail"), "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        "l_linestatus", "s_acctbal", ((F.col("l_quantity") + 100 * F.col("l_discount")) / 60).alias("score"),
    )


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))
    return series.series_of(orders, "month", "urgent", name="urgent")


ROLES = QualitySchema(label="is_fail", unit="l_orderkey", run="l_suppkey", batch="s_nationkey", run_numeric=("s_acctbal",), batch_numeric=(), run_categorical=(), batch_categorical=("n_regionkey",), measured=(), limits={"discount": (0.0, 0.1), "quantity": (1.0, 45.0)})
_LIMITS = {"discount": (0.0, 0.1), "quantity": (1.0, 45.0)}
_DIRTY_COLUMNS = ("l_orderkey", "l_linenumber", "quantity", "discount", "plant", "archived", "reading", "l_returnflag", "l_extendedprice")


def _union(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(parts)


# --- missing values and types -----------------------------------------------


@_query(_union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS n_rows, 100.0 * (count(*) - count({c})) / count(*) AS pct, count({c}) = 0 AS all_missing FROM {_DIRTY_SQL}" for c in _DIRTY_COLUMNS]), "pct", "column n_missing n_rows all_missing")
def null_profile(spark, sf_dir):
    return quality.missing_by_column(_dirty(spark, sf_dir))


@_query(f"SELECT CAST({' + '.join(f'CAST({c} IS NULL AS INT)' for c in _DIRTY_COLUMNS)} AS INT) AS n_missing, count(*) AS n_rows FROM {_DIRTY_SQL} GROUP BY 1", "", "n_missing n_rows")
def missing_by_row(spark, sf_dir):
    return quality.missing_by_row(_dirty(spark, sf_dir))


@_query(f"SELECT 'reading' AS \"column\", count(*) AS n_unparsable, min(reading) AS example FROM {_DIRTY_SQL} WHERE reading IS NOT NULL AND TRY_CAST(reading AS DOUBLE) IS NULL HAVING count(*) > 0", "", "column n_unparsable example")
def dtype_issues(spark, sf_dir):
    return quality.dtype_issues(_dirty(spark, sf_dir), ["reading"]).drop("examples")


# --- integration and cleaning -----------------------------------------------

_PERF_SQL = """SELECT n_name, count(*) AS n_orders, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS fail_rate, avg(q) AS mean_quantity, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_lines
 FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""


@_query(_PERF_SQL, "fail_rate mean_quantity", "n_name n_orders n_lines")
def perf_agg_join(spark, sf_dir):
    """Lines are aggregated per order before the join, so that orders with many lines count once."""
    lines = integrate.aggregate_child(_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity"], "n").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = integrate.many_to_one(_table(spark, sf_dir, "orders"), lines, "o_orderkey", check=False)
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = integrate.many_to_one(orders, customers, "o_custkey").join(F.broadcast(_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("fail_rate"), F.avg("l_quantity").alias("mean_quantity"), F.sum(F.coalesce("n", F.lit(0))).alias("n_lines"))


_ROLLUP = "avg(is_fail) AS fail_rate, count(*) AS n_units, CAST(sum(is_fail) AS BIGINT) AS n_fail"


@_query(f"SELECT l_suppkey, {_ROLLUP}, min(s_acctbal) AS s_acctbal, min(s_nationkey) AS s_nationkey FROM {_UNITS_SQL} GROUP BY 1", "fail_rate s_acctbal", "l_suppkey n_units n_fail s_nationkey")
def run_rollup(spark, sf_dir):
    return integrate.build_run_level_table(_units(spark, sf_dir), ROLES).select("l_suppkey", "fail_rate", "n_units", "n_fail", "s_acctbal", "s_nationkey")


@_query(f"SELECT s_nationkey, {_ROLLUP}, count(DISTINCT l_suppkey) AS n_runs, min(n_regionkey) AS n_regionkey FROM {_UNITS_SQL} GROUP BY 1", "fail_rate", "s_nationkey n_units n_fail n_runs n_regionkey")
def batch_rollup(spark, sf_dir):
    return integrate.build_batch_level_table(_units(spark, sf_dir), ROLES).select("s_nationkey", "fail_rate", "n_units", "n_fail", "n_runs", "n_regionkey")


_CLEAN_ROLES = QualitySchema(label="l_returnflag", run_numeric=("quantity", "discount"), batch_numeric=(), run_categorical=(), batch_categorical=(), measured=("quantity",), limits=_LIMITS)
_NULLED_SQL = f"(SELECT * REPLACE (CASE WHEN quantity BETWEEN 1 AND 45 THEN quantity END AS quantity, CASE WHEN discount BETWEEN 0 AND 0.1 THEN discount END AS discount) FROM (SELECT DISTINCT * FROM {_DIRTY_SQL}))"


@_query(f"""SELECT l_orderkey, l_linenumber, coalesce(quantity, (SELECT median(quantity) FROM {_NULLED_SQL})) AS quantity, coalesce(discount, (SELECT median(discount) FROM {_NULLED_SQL})) AS discount,
 l_extendedprice, quantity IS NULL AS quantity_was_missing FROM {_NULLED_SQL} WHERE l_returnflag IS NOT NULL""", "quantity discount l_extendedprice", "l_orderkey l_linenumber quantity_was_missing")
def clean_table(spark, sf_dir):
    out, _ = integrate.clean(_dirty(spark, sf_dir), _CLEAN_ROLES)
    return out.select("l_orderkey", "l_linenumber", "quantity", "discount", "l_extendedprice", "quantity_was_missing")


@_query(f"""SELECT (SELECT count(*) FROM {_DIRTY_SQL}) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DIRTY_SQL})) AS rows_after_dedup,
 (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DIRTY_SQL}) WHERE discount < 0 OR discount > 0.1) AS discount_out, (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DIRTY_SQL}) WHERE quantity < 1 OR quantity > 45) AS quantity_out,
 (SELECT median(quantity) FROM {_NULLED_SQL}) AS quantity_median""", "quantity_median", "rows_before rows_after_dedup discount_out quantity_out")
def clean_actions(spark, sf_dir):
    _, a = integrate.clean(_dirty(spark, sf_dir), _CLEAN_ROLES)
    out = a["out_of_range_to_nan"]
    return spark.createDataFrame([(a["rows_before"], a["rows_after_dedup"], out.get("discount", 0), out.get("quantity", 0), a["numeric_median_imputed"].get("quantity"))], "rows_before long, rows_after_dedup long, discount_out long, quantity_out long, quantity_median double")


@_query("SELECT n AS n_children, count(*) AS n_parents FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1", "", "n_children n_parents")
def fanout(spark, sf_dir):
    return quality.fanout(_table(spark, sf_dir, "lineitem"), "l_orderkey")


# --- quality ------------------------------------------------------------------


def _range_sql(c: str, lo: float, hi: float) -> str:
    bad = f"({c} < {lo} OR {c} > {hi})"
    first = f"(SELECT {c} FROM {_DIRTY_SQL} WHERE {bad} ORDER BY l_orderkey, {c} LIMIT 1)"
    worst = f"(SELECT {c} FROM {_DIRTY_SQL} WHERE {bad} ORDER BY greatest({lo} - {c}, {c} - {hi}) DESC, {c} DESC LIMIT 1)"
    return f"SELECT '{c}' AS \"column\", {lo} AS lower, {hi} AS upper, count(*) FILTER ({c} < {lo}) AS n_below, count(*) FILTER ({c} > {hi}) AS n_above, count(*) FILTER {bad} AS n_out_of_range, 100.0 * count(*) FILTER {bad} / count(*) AS pct, {first} AS first_example, {worst} AS worst_example FROM {_DIRTY_SQL}"


@_query(_union([_range_sql(c, lo, hi) for c, (lo, hi) in _LIMITS.items()]), "lower upper pct first_example worst_example", "column n_below n_above n_out_of_range")
def out_of_range(spark, sf_dir):
    return quality.out_of_range(_dirty(spark, sf_dir), _LIMITS, "l_orderkey")


@_query(_union([f"SELECT '(row)' AS what, (SELECT count(*) FROM {_DIRTY_SQL}) AS n_rows, count(*) AS n_unique, (SELECT count(*) FROM {_DIRTY_SQL}) - count(*) AS n_beyond_first, (SELECT count(*) FROM {_DIRTY_SQL}) = count(*) AS is_unique FROM (SELECT DISTINCT * FROM {_DIRTY_SQL})",
                f"SELECT 'l_orderkey' AS what, count(l_orderkey) AS n_rows, count(DISTINCT l_orderkey) AS n_unique, count(l_orderkey) - count(DISTINCT l_orderkey) AS n_beyond_first, count(l_orderkey) = count(DISTINCT l_orderkey) AS is_unique FROM {_DIRTY_SQL}"]), "", "what n_rows n_unique n_beyond_first is_unique")
def duplicates(spark, sf_dir):
    return quality.duplicates(_dirty(spark, sf_dir), ["l_orderkey"])


def _constant_sql(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    top = f"(SELECT {{0}} FROM (SELECT {v} AS v, count(*) AS n FROM {_DIRTY_SQL} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
    share = f"{top.format('n')} / CAST(count({c}) AS DOUBLE)"
    return f"SELECT '{c}' AS \"column\", count({c}) AS n_valid, count(DISTINCT {c}) AS n_unique, {top.format('v')} AS top_value, {share} AS top_share, count(DISTINCT {c}) <= 1 AS is_constant, count(DISTINCT {c}) > 1 AND {share} >= 0.99 AS is_near_constant FROM {_DIRTY_SQL}"


@_query(_union([_constant_sql(c) for c in ("plant", "archived", "reading", "l_returnflag", "l_linenumber")]), "top_share", "column n_valid n_unique top_value is_constant is_near_constant")
def constant_columns(spark, sf_dir):
    return quality.constant_columns(_dirty(spark, sf_dir).select("plant", "archived", "reading", "l_returnflag", "l_linenumber"))


@_query("""SELECT n, n_pos, n_neg, n_pos / CAST(n AS DOUBLE) AS positive_rate, n_neg / CAST(n_pos AS DOUBLE) AS neg_pos_ratio, least(n_pos, n_neg) / CAST(n AS DOUBLE) AS minority_share,
 CASE WHEN n = 0 THEN 'empty' WHEN n_pos = 0 OR n_neg = 0 THEN 'degenerate' WHEN least(n_pos, n_neg) / CAST(n AS DOUBLE) < 0.05 THEN 'severe' WHEN least(n_pos, n_neg) / CAST(n AS DOUBLE) < 0.2 THEN 'moderate' ELSE 'balanced' END AS severity
 FROM (SELECT count(toxic) AS n, count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic = 0) AS n_neg FROM labels)""", "positive_rate neg_pos_ratio minority_share", "n n_pos n_neg severity")
def class_balance(spark, sf_dir):
    return quality.class_balance(_table(spark, sf_dir, "labels"), "toxic")


@_query("""SELECT month, row_number() OVER (ORDER BY start, month) <= (SELECT greatest(1, round_even(0.25 * count(DISTINCT strftime(o_orderdate, '%Y-%m')), 0)) FROM orders) AS is_baseline
 FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, min(o_orderdate) AS start FROM orders GROUP BY 1)""", "", "month is_baseline")
def baseline_mask(spark, sf_dir):
    months = _table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderdate")
    return quality.baseline_keys(months, "month", "o_orderdate").select("month", "is_baseline")


_DRIFT = ("l_quantity", "l_extendedprice", "l_discount")


def _sides(spark, sf_dir) -> DataFrame:
    """A drift is put in: later lines have a larger quantity."""
    line = _table(spark, sf_dir, "lineitem")
    base = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return line.select(base.alias("is_baseline"), F.when(base, F.col("l_quantity")).otherwise(F.col("l_quantity") + 15).alias("l_quantity"), "l_extendedprice", "l_discount")


_SIDES_SQL = "(SELECT l_shipdate < TIMESTAMP '1997-01-01' AS is_baseline, CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN l_quantity ELSE l_quantity + 15 END AS l_quantity, l_extendedprice, l_discount FROM lineitem)"


def _ks_sql(c: str) -> str:
    hist = f"(SELECT {c} AS v, count(*) FILTER (is_baseline) AS a, count(*) FILTER (NOT is_baseline) AS b FROM {_SIDES_SQL} GROUP BY 1)"
    run = f"(SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS g FROM {hist})"
    return f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM {_SIDES_SQL} WHERE is_baseline) AS n1, (SELECT count(*) FROM {_SIDES_SQL} WHERE NOT is_baseline) AS n2, (SELECT max(abs(f - g)) FROM {run}) AS ks"


@_query(_union([_ks_sql(c) for c in _DRIFT]), "ks", "column n1 n2")
def ks_statistic(spark, sf_dir):
    return quality.ks_statistic(quality.long(_sides(spark, sf_dir), _DRIFT, "is_baseline"), "is_baseline")


def _psi_sql(c: str) -> str:
    q = f"(SELECT list_distinct(list_sort(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM {_SIDES_SQL} WHERE is_baseline)"
    q = f"(SELECT list_sort(q) AS q FROM {q})"
    bins = f"(SELECT len(list_filter(q[2:len(q) - 1], lambda e: e <= {c})) AS bin, is_baseline FROM {_SIDES_SQL}, {q})"
    counts = f"(SELECT bin, count(*) FILTER (is_baseline) AS a, count(*) FILTER (NOT is_baseline) AS b FROM {bins} GROUP BY 1)"
    every = f"(SELECT unnest(range(0, len(q) - 1)) AS bin FROM {q})"
    share = f"(SELECT greatest(1e-6, coalesce(a, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM {_SIDES_SQL} WHERE is_baseline)) AS p, greatest(1e-6, coalesce(b, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM {_SIDES_SQL} WHERE NOT is_baseline)) AS r FROM {every} LEFT JOIN {counts} USING (bin))"
    return f"SELECT '{c}' AS \"column\", (SELECT sum((r - p) * ln(r / p)) FROM {share}) AS psi"


@_query(_union([_psi_sql(c) for c in _DRIFT]), "psi", "column")
def psi(spark, sf_dir):
    return quality.psi(quality.long(_sides(spark, sf_dir), _DRIFT, "is_baseline"), "is_baseline")


_DRIFT_SQL = "SELECT k.\"column\", n1, n2, baseline_mean, current_mean, 100 * (current_mean - baseline_mean) / abs(baseline_mean) AS mean_shift_pct, ks, psi, CASE WHEN psi >= 0.25 AND ks >= 0.2 THEN 'significant' WHEN psi >= 0.1 THEN 'watch' ELSE 'stable' END AS severity FROM ({0}) k JOIN ({1}) p ON k.\"column\" = p.\"column\" JOIN ({2}) m ON k.\"column\" = m.\"column\"".format(
    _union([_ks_sql(c) for c in _DRIFT]), _union([_psi_sql(c) for c in _DRIFT]), _union([f"SELECT '{c}' AS \"column\", avg({c}) FILTER (is_baseline) AS baseline_mean, avg({c}) FILTER (NOT is_baseline) AS current_mean FROM {_SIDES_SQL}" for c in _DRIFT]))


@_query(_DRIFT_SQL, "baseline_mean current_mean mean_shift_pct ks psi", "column n1 n2 severity")
def drift_report(spark, sf_dir):
    return quality.drift(_sides(spark, sf_dir), _DRIFT, "is_baseline")


# --- statistical kernels --------------------------------------------------------

_NUMERIC = ("l_quantity", "l_discount", "s_acctbal")


def _flat(spark, sf_dir, columns=_NUMERIC) -> DataFrame:
    return quality.long(_units(spark, sf_dir), columns, "is_fail").withColumnRenamed("column", "factor").withColumn("fails", F.col("is_fail") == 1)


_FLAT_SQL = "(" + _union([f"SELECT '{c}' AS factor, {c} AS value, is_fail FROM {_UNITS_SQL}" for c in _NUMERIC]) + ")"
_RANKS_SQL = f"(SELECT *, rank() OVER (PARTITION BY factor ORDER BY value) + (count(*) OVER (PARTITION BY factor, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY factor, value) AS t FROM {_FLAT_SQL})"


@_query(f"""SELECT factor, n_a, n_b, s - n_a * (n_a + 1) / 2.0 AS u, ties, 2 * (s - n_a * (n_a + 1) / 2.0) / (CAST(n_a AS DOUBLE) * n_b) - 1 AS rank_biserial FROM (
 SELECT factor, count(*) FILTER (is_fail = 1) AS n_a, count(*) FILTER (is_fail = 0) AS n_b, sum(r) FILTER (is_fail = 1) AS s, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM {_RANKS_SQL} GROUP BY 1)""", "u ties rank_biserial", "factor n_a n_b")
def mann_whitney_u(spark, sf_dir):
    return stats.mann_whitney_u(_flat(spark, sf_dir), ["factor"], "fails")


def _chi_sql(pairs: Sequence[tuple[str, str]]) -> str:
    out = []
    for a, b in pairs:
        cells = f"(SELECT {a} AS a, {b} AS b, count(*) AS o FROM {_UNITS_SQL} GROUP BY 1, 2)"
        marg = f"(SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c FROM {cells})"
        out.append(f"SELECT '{a}' AS factor, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS n_rows, count(DISTINCT b) AS n_cols, sum(o) * (sum(CAST(o AS DOUBLE) * o / (CAST(r AS DOUBLE) * c)) - 1) AS chi2 FROM {marg}")
    return _union(out)


_CHI_SQL = _chi_sql([("n_regionkey", "is_fail"), ("l_linestatus", "is_fail")])


def _chi(spark, sf_dir) -> DataFrame:
    flat = quality.long(_units(spark, sf_dir), ("n_regionkey", "l_linestatus"), "is_fail", kind="string").withColumnRenamed("column", "factor")
    return stats.chi_square(flat, ["factor"], "value", "is_fail")


@_query(f"SELECT *, (n_rows - 1) * (n_cols - 1) AS dof FROM ({_CHI_SQL})", "chi2", "factor n n_rows n_cols dof")
def chi_square(spark, sf_dir):
    return _chi(spark, sf_dir).drop("cramers_v")


@_query(f"SELECT factor, sqrt(chi2 / (n * (least(n_rows, n_cols) - 1))) AS cramers_v FROM ({_CHI_SQL})", "cramers_v", "factor")
def cramers_v(spark, sf_dir):
    return _chi(spark, sf_dir).select("factor", "cramers_v")


_GROUPS_SQL = f"(SELECT factor, count(*) FILTER (is_fail = 1) AS n_a, count(*) FILTER (is_fail = 0) AS n_b, avg(value) FILTER (is_fail = 1) AS m_a, avg(value) FILTER (is_fail = 0) AS m_b, var_samp(value) FILTER (is_fail = 1) AS v_a, var_samp(value) FILTER (is_fail = 0) AS v_b FROM {_FLAT_SQL} GROUP BY 1)"


@_query(f"SELECT factor, (m_a - m_b) / sqrt(v_a / n_a + v_b / n_b) AS t, (v_a / n_a + v_b / n_b) ** 2 / ((v_a / n_a) ** 2 / (n_a - 1) + (v_b / n_b) ** 2 / (n_b - 1)) AS df FROM {_GROUPS_SQL}", "t df", "factor")
def welch_t(spark, sf_dir):
    t, df = stats.welch()
    return stats.two_groups(_flat(spark, sf_dir), ["factor"], "fails").select("factor", t.alias("t"), df.alias("df"))


@_query(f"SELECT factor, (m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) AS d FROM {_GROUPS_SQL}", "d", "factor")
def cohens_d(spark, sf_dir):
    return stats.two_groups(_flat(spark, sf_dir), ["factor"], "fails").select("factor", stats.cohens_d().alias("d"))


def _welch_p_sql() -> str:
    """t's tail by Simpson's rule over 2,000 steps, its quantile by the series of Cornish and Fisher, right to six places at 60 degrees of freedom and more."""
    z = 1.959963984540054  # normal quantile of 0.975
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    quantile = f"({z!r} + " + " + ".join(f"{x!r} / pow(df, {i})" for i, x in enumerate(g, 1)) + ")"
    sides = f"(SELECT factor, avg(value) FILTER (is_fail = 1) - avg(value) FILTER (is_fail = 0) AS d, var_samp(value) FILTER (is_fail = 1) / count(*) FILTER (is_fail = 1) AS sa, var_samp(value) FILTER (is_fail = 0) / count(*) FILTER (is_fail = 0) AS sb, count(*) FILTER (is_fail = 1) AS na, count(*) FILTER (is_fail = 0) AS nb FROM {_FLAT_SQL} GROUP BY 1)"
    tests = f"(SELECT factor, d, sqrt(sa + sb) AS se, d / sqrt(sa + sb) AS t, pow(sa + sb, 2) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) AS df FROM {sides})"
    density = "sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 2000, 2) / df, -(df + 1) / 2))"
    scale = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())"
    return f"SELECT factor, t, df, 1 - 2 * abs(t) / 6000 * {scale} * {density} AS p_value, d - {quantile} * se AS ci_low, d + {quantile} * se AS ci_high FROM {tests}, range(2001) r(i) GROUP BY factor, d, se, t, df"


@_query(_welch_p_sql(), "t df p_value ci_low ci_high", "factor")
def welch_p(spark, sf_dir):
    """The finished tests: p, confidence limits."""
    rows = [(r["factor"], *[(w := stats.welch_ttest(r.asDict()))[k] for k in ("t", "df", "p_value")], *(w["ci95"] or (None, None))) for r in stats.two_groups(_flat(spark, sf_dir), ["factor"], "fails").collect()]
    return spark.createDataFrame(rows, "factor string, t double, df double, p_value double, ci_low double, ci_high double")


@_query(f"SELECT factor, count(*) AS n, corr(value, is_fail) AS r FROM {_FLAT_SQL} GROUP BY 1", "r", "factor n")
def point_biserial(spark, sf_dir):
    return _flat(spark, sf_dir).groupBy("factor").agg(F.count(F.lit(1)).alias("n"), stats.correlation(F.col("value"), F.col("is_fail").cast("double")).alias("r"))


_SPEARMAN_SQL = f"""(SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
 FROM (SELECT min(s_acctbal) AS x, avg(is_fail) AS y FROM {_UNITS_SQL} GROUP BY l_suppkey))"""


@_query(f"SELECT 's_acctbal' AS factor, count(*) AS n, corr(rx, ry) AS rho FROM {_SPEARMAN_SQL}", "rho", "factor n")
def spearman(spark, sf_dir):
    runs = integrate.build_run_level_table(_units(spark, sf_dir), ROLES).withColumn("factor", F.lit("s_acctbal"))
    return stats.spearman(runs, ["factor"], "s_acctbal", "fail_rate")


_KRUSKAL_SQL = f"(SELECT n_regionkey AS g, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY y) AS t FROM (SELECT s_nationkey, min(n_regionkey) AS n_regionkey, avg(is_fail) AS y FROM {_UNITS_SQL} GROUP BY 1))"


@_query(f"""SELECT 'n_regionkey' AS factor, n, n_groups, h, n_groups - 1 AS dof, greatest(0, (h - n_groups + 1) / (n - n_groups)) AS effect FROM (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS n_groups,
 (12.0 / (sum(c) * (sum(c) + 1)) * sum(s * s / c) - 3 * (sum(c) + 1)) / (1 - (SELECT sum(CAST(t AS DOUBLE) * t - 1) FROM {_KRUSKAL_SQL}) / (sum(c) ** 3 - sum(c))) AS h FROM (SELECT g, count(*) AS c, sum(r) AS s FROM {_KRUSKAL_SQL} GROUP BY 1))""", "h effect", "factor n n_groups dof")
def kruskal_h(spark, sf_dir):
    batches = integrate.build_batch_level_table(_units(spark, sf_dir), ROLES).withColumn("factor", F.lit("n_regionkey"))
    return stats.kruskal(batches, ["factor"], "n_regionkey", "fail_rate")


_P_SQL = "(SELECT n_nationkey, n_regionkey, ((n_nationkey * 37 + 11) % 101) / 400.0 AS p_value FROM nation)"


@_query(f"""SELECT n_nationkey, p_value, q, q <= 0.05 AS rejected FROM (SELECT n_nationkey, p_value, least(1, min(p_value * m / i) OVER (PARTITION BY n_regionkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q
 FROM (SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS m, row_number() OVER (PARTITION BY n_regionkey ORDER BY p_value, n_nationkey) AS i FROM {_P_SQL}))""", "p_value q", "n_nationkey rejected")
def bh_fdr(spark, sf_dir):
    tests = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (((F.col("n_nationkey") * 37 + 11) % 101) / 400.0).alias("p_value"))
    return stats.benjamini_hochberg(tests, "p_value", ["n_regionkey"]).select("n_nationkey", "p_value", "q", "rejected")


# --- permutation, screening -----------------------------------------------------


@_query(f"SELECT avg(s_acctbal) FILTER (is_fail = 1) - avg(s_acctbal) FILTER (is_fail = 0) AS statistic, count(DISTINCT l_suppkey) AS n_clusters FROM {_UNITS_SQL}", "statistic", "n_clusters")
def cluster_perm_observed(spark, sf_dir):
    got = stats.cluster_permutation(_units(spark, sf_dir), "l_suppkey", "s_acctbal", "is_fail", n_perm=1)
    return spark.createDataFrame([(got["statistic"], got["n_clusters"])], "statistic double, n_clusters long")


@_query()
def cluster_perm_p(spark, sf_dir):
    units = _units(spark, sf_dir)
    rows = []
    for f, cluster_, kind in (("s_acctbal", "l_suppkey", "numeric"), ("n_regionkey", "s_nationkey", "categorical")):
        got = stats.cluster_permutation(units, cluster_, f, "is_fail", seed=7, kind=kind)
        rows.append((f, got["statistic"], got["p_value"], got["n_clusters"]))
    return spark.createDataFrame(rows, "factor string, statistic double, p_value double, n_clusters long")


_SCREEN_SQL = _union([
    f"SELECT 's_acctbal' AS factor, 'mann_whitney' AS method, s - n_a * (n_a + 1) / 2.0 AS statistic FROM (SELECT count(*) FILTER (is_fail = 1) AS n_a, sum(r) FILTER (is_fail = 1) AS s FROM {_RANKS_SQL} WHERE factor = 's_acctbal')",
    f"SELECT factor, 'chi_square' AS method, chi2 AS statistic FROM ({_CHI_SQL}) WHERE factor = 'n_regionkey'",
    f"SELECT 's_acctbal' AS factor, 'point_biserial' AS method, corr(s_acctbal, is_fail) AS statistic FROM {_UNITS_SQL}",
    f"SELECT 's_acctbal' AS factor, 'cluster_permutation' AS method, avg(s_acctbal) FILTER (is_fail = 1) - avg(s_acctbal) FILTER (is_fail = 0) AS statistic FROM {_UNITS_SQL}",
    f"SELECT factor, 'cluster_permutation' AS method, sqrt(chi2 / n) AS statistic FROM ({_CHI_SQL}) WHERE factor = 'n_regionkey'",
    f"SELECT 's_acctbal' AS factor, 'spearman_vs_fail_rate' AS method, corr(rx, ry) AS statistic FROM {_SPEARMAN_SQL}",
    f"SELECT 'n_regionkey' AS factor, 'kruskal_wallis' AS method, (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) AS statistic FROM (SELECT sum(c) AS n, sum(s * s / c) AS q, (SELECT sum(CAST(t AS DOUBLE) * t - 1) FROM {_KRUSKAL_SQL}) AS t FROM (SELECT g, count(*) AS c, sum(r) AS s FROM {_KRUSKAL_SQL} GROUP BY 1))",
])


def _screen(spark, sf_dir) -> DataFrame:
    units = _units(spark, sf_dir)
    return significance.screen_factors(units, integrate.build_run_level_table(units, ROLES), integrate.build_batch_level_table(units, ROLES), roles=ROLES)


@_query(_SCREEN_SQL, "statistic", "factor method")
def factor_screen(spark, sf_dir):
    return _screen(spark, sf_dir).select("factor", "method", "statistic")


@_query()
def factor_ranking(spark, sf_dir):
    return significance.rank_factors(_screen(spark, sf_dir))


@_query(f"SELECT factor, sum(o / n * ln(o * n / (r * c))) AS mi FROM (SELECT factor, CAST(o AS DOUBLE) AS o, sum(o) OVER (PARTITION BY factor) AS n, sum(o) OVER (PARTITION BY factor, a) AS r, sum(o) OVER (PARTITION BY factor, is_fail) AS c FROM ({_union([f'SELECT {chr(39)}{c}{chr(39)} AS factor, CAST({c} AS VARCHAR) AS a, is_fail, count(*) AS o FROM {_UNITS_SQL} GROUP BY 2, 3' for c in ('n_regionkey', 'l_linestatus')])})) GROUP BY 1", "mi", "factor")
def mi_discrete(spark, sf_dir):
    flat = quality.long(_units(spark, sf_dir), ("n_regionkey", "l_linestatus"), "is_fail", kind="string").withColumnRenamed("column", "factor")
    return stats.mutual_information(flat, ["factor"], "value", "is_fail")


# --- series -----------------------------------------------------------------------


@_query(f"SELECT pos, value, CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END AS moving_average FROM {_MONTHS_SQL} WINDOW w AS (ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "value moving_average", "pos")
def moving_average(spark, sf_dir):
    return series.moving_average(_months(spark, sf_dir)).select("pos", "value", "moving_average")


@_query(f"SELECT 'urgent' AS series, count(*) AS n, regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept, regr_r2(value, pos) AS r2 FROM {_MONTHS_SQL}", "slope intercept r2", "series n")
def linear_trend(spark, sf_dir):
    return series.linear_trend(_months(spark, sf_dir))


_PAIRS_SQL = f"(SELECT a.value AS yi, b.value AS yj, b.pos - a.pos AS d FROM {_MONTHS_SQL} a JOIN {_MONTHS_SQL} b ON a.pos < b.pos)"


@_query(f"SELECT 'urgent' AS series, median((yj - yi) / d) AS sen_slope FROM {_PAIRS_SQL}", "sen_slope", "series")
def sen_slope(spark, sf_dir):
    return series.sen_slope(_months(spark, sf_dir))


@_query(f"""SELECT series, n, s, var_s, (s - sign(s)) / sqrt(var_s) AS z, sen_slope FROM (SELECT 'urgent' AS series, CAST(sum(sign(yj - yi)) AS BIGINT) AS s, median((yj - yi) / d) AS sen_slope FROM {_PAIRS_SQL}),
 (SELECT CAST(sum(t) AS BIGINT) AS n, (sum(t) * (sum(t) - 1) * (2 * sum(t) + 5) - sum(t * (t - 1) * (2 * t + 5))) / 18.0 AS var_s FROM (SELECT count(*) AS t FROM {_MONTHS_SQL} GROUP BY value))""", "var_s z sen_slope", "series n s")
def mann_kendall(spark, sf_dir):
    return series.mann_kendall(_months(spark, sf_dir))


@_query(f"SELECT 'urgent' AS series, (SELECT count(*) FROM {_MONTHS_SQL}) AS n, corr(b, value) AS r1 FROM (SELECT value, lag(value) OVER (ORDER BY pos) AS b FROM {_MONTHS_SQL}) WHERE b IS NOT NULL", "r1", "series n")
def lag1_autocorr(spark, sf_dir):
    return series.lag1(_months(spark, sf_dir))


_SES_SQL = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT * FROM {_MONTHS_SQL}), grid AS (SELECT i * 5 / 100.0 AS a FROM range(1, 20) t(i)), walk AS (
 SELECT a, 0 AS pos, value AS level, value AS stale, CAST(0 AS DOUBLE) AS sse FROM grid, m WHERE pos = 0
 UNION ALL SELECT a, m.pos, a * m.value + (1 - a) * level, level, sse + (m.value - level) * (m.value - level) FROM walk JOIN m ON m.pos = walk.pos + 1)
 SELECT 'urgent' AS series, (SELECT count(*) FROM m) AS n, CAST(a AS DOUBLE) AS alpha, sse, stale AS next_forecast, level AS last_level FROM walk WHERE pos = (SELECT max(pos) FROM m) ORDER BY sse, a LIMIT 1"""


@_query(_SES_SQL, "alpha sse next_forecast last_level", "series n")
def ses(spark, sf_dir):
    return series.smoothing(_months(spark, sf_dir))


@_query(f"SELECT 'urgent' AS series, (SELECT count(*) FROM {_MONTHS_SQL}) AS n, regr_slope(value, b) AS phi, regr_intercept(value, b) AS c, regr_r2(value, b) AS r2, regr_intercept(value, b) + regr_slope(value, b) * (SELECT value FROM {_MONTHS_SQL} ORDER BY pos DESC LIMIT 1) AS next_forecast FROM (SELECT value, lag(value) OVER (ORDER BY pos) AS b FROM {_MONTHS_SQL})", "phi c r2 next_forecast", "series n")
def ar1(spark, sf_dir):
    return series.ar1(_months(spark, sf_dir))


_BACK_SQL = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT *, lag(value) OVER (ORDER BY pos) AS b FROM {_MONTHS_SQL}), grid AS (SELECT i * 5 / 100.0 AS a FROM range(1, 20) t(i)), walk AS (
 SELECT a, 0 AS pos, value AS level, CAST(0 AS DOUBLE) AS sse FROM grid, m WHERE pos = 0
 UNION ALL SELECT a, m.pos, a * m.value + (1 - a) * level, sse + (m.value - level) * (m.value - level) FROM walk JOIN m ON m.pos = walk.pos + 1),
 best AS (SELECT pos + 1 AS pos, arg_min(level, sse) AS f FROM walk GROUP BY 1),
 said AS (SELECT m.pos, m.value, b AS "last", avg(m.value) OVER w AS mean, regr_intercept(m.value, b) OVER w + regr_slope(m.value, b) OVER w * b AS ar1, f AS ses FROM m LEFT JOIN best USING (pos) WINDOW w AS (ORDER BY m.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 """ + _union([f"SELECT 'urgent' AS series, '{k}' AS method, count(*) AS n, avg(abs(\"{k}\" - value)) AS mae, sqrt(avg((\"{k}\" - value) ** 2)) AS rmse FROM said WHERE pos >= 5" for k in ("ses", "ar1", "mean", "last")])


@_query(_BACK_SQL, "mae rmse", "series method n")
def backtest(spark, sf_dir):
    return series.backtest(_months(spark, sf_dir))


# --- evaluation ---------------------------------------------------------------------

_CONFUSION_SQL = f"(SELECT count(*) FILTER (is_fail = 0 AND score < 0.5) AS tn, count(*) FILTER (is_fail = 0 AND score >= 0.5) AS fp, count(*) FILTER (is_fail = 1 AND score < 0.5) AS fn, count(*) FILTER (is_fail = 1 AND score >= 0.5) AS tp FROM {_UNITS_SQL})"


@_query(f"""SELECT tn, fp, fn, tp, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, tn / CAST(tn + fp AS DOUBLE) AS specificity, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy,
 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1, (tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2 AS balanced_accuracy FROM {_CONFUSION_SQL}""", "precision recall specificity accuracy f1 balanced_accuracy", "tn fp fn tp")
def confusion_prf(spark, sf_dir):
    return evaluate.confusion(_units(spark, sf_dir), "is_fail", F.col("score") >= 0.5)


_CURVE_SQL = f"(SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM (SELECT score, count(*) FILTER (is_fail = 1) AS pos, count(*) FILTER (is_fail = 0) AS neg FROM {_UNITS_SQL} GROUP BY 1))"


@_query(f"SELECT sum(neg * (tp - pos / 2.0)) / (CAST(any_value(p) AS DOUBLE) * any_value(q)) AS roc_auc FROM {_CURVE_SQL}", "roc_auc")
def roc_auc(spark, sf_dir):
    return evaluate.ranking_metrics(_units(spark, sf_dir), "is_fail", "score").select("roc_auc")


@_query(f"SELECT sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / any_value(p) AS average_precision FROM {_CURVE_SQL}", "average_precision")
def average_precision(spark, sf_dir):
    return evaluate.ranking_metrics(_units(spark, sf_dir), "is_fail", "score").select("average_precision")


@_query(f"SELECT avg((score - is_fail) * (score - is_fail)) AS brier FROM {_UNITS_SQL}", "brier")
def brier(spark, sf_dir):
    return evaluate.ranking_metrics(_units(spark, sf_dir), "is_fail", "score").select("brier")


@_query(f"SELECT score AS threshold, 2.0 * tp / (tp + fp + p) AS f1 FROM {_CURVE_SQL} ORDER BY 2 DESC, 1 LIMIT 1", "threshold f1")
def threshold_f1(spark, sf_dir):
    got = evaluate.threshold(_units(spark, sf_dir), "is_fail", "score")
    return spark.createDataFrame([(got["threshold"], got["score"])], "threshold double, f1 double")


_REG_SQL = "(SELECT CAST(n_chars AS DOUBLE) AS y, CAST(6 * (length(text) - length(replace(text, ' ', '')) + 1) AS DOUBLE) AS p FROM documents)"


def _predicted(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("n_chars").cast("double").alias("y"), (6 * (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1)).cast("double").alias("p"))


_REG = "count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, 1 - avg((p - y) ** 2) / var_pop(y) AS r2, avg(y) AS target_mean, stddev_pop(y) AS target_std"


@_query(f"SELECT {_REG} FROM {_REG_SQL}", "mae rmse r2 target_mean target_std", "n")
def regression_metrics(spark, sf_dir):
    return evaluate.regression_metrics(_predicted(spark, sf_dir), "y", "p")


@_query(f"SELECT {_REG} FROM (SELECT y, (SELECT avg(y) FROM {_REG_SQL}) AS p FROM {_REG_SQL})", "mae rmse r2 target_mean target_std", "n")
def mean_baseline(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    return evaluate.regression_metrics(rows.withColumn("p", F.lit(rows.agg(F.avg("y")).first()[0])), "y", "p")


@_query("""SELECT toxic, part, n FROM (SELECT toxic, round_even(count(*) * 0.2, 0) AS t, count(*) AS c, round_even((count(*) - round_even(count(*) * 0.2, 0)) * 0.2, 0) AS v FROM labels GROUP BY 1),
 LATERAL (SELECT 'test' AS part, CAST(t AS BIGINT) AS n UNION ALL SELECT 'validation', CAST(v AS BIGINT) UNION ALL SELECT 'train', CAST(c - t - v AS BIGINT)) WHERE n > 0""", "", "toxic part n")
def strat_split_sizes(spark, sf_dir):
    return evaluate.split(_table(spark, sf_dir, "labels"), "toxic", ("doc_id",)).groupBy("toxic", "part").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT toxic, CAST(i % 5 AS INT) AS fold, count(*) AS n FROM (SELECT toxic, unnest(range(1, count(*) + 1)) AS i FROM labels GROUP BY 1) GROUP BY 1, 2", "", "toxic fold n")
def cv_folds(spark, sf_dir):
    return evaluate.folds(_table(spark, sf_dir, "labels"), "toxic", ("doc_id",)).groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n"))


# --- clustering -------------------------------------------------------------------------

_DIMS = 64
_FEATURES = [f"x{i}" for i in range(_DIMS)]
_POINTS_SQL = "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(_DIMS)) + " FROM embeddings)"


def _points(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(_DIMS)])


def _distance(a: str, b: str) -> str:
    return " + ".join(f"({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i})" for i in range(_DIMS))


_CENTROID_SQL = f"(SELECT label, count(*) AS n, {', '.join(f'avg({x}) AS {x}' for x in _FEATURES)} FROM {_POINTS_SQL} GROUP BY 1)"


@_query(f"""SELECT count(*) AS n, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (SELECT k, max(d) FILTER (l1 = l2) AS a, min(d) FILTER (l1 <> l2) AS b FROM
 (SELECT p.vec_id AS k, p.label AS l1, q.label AS l2, avg(sqrt({_distance('p', 'q')})) AS d FROM {_POINTS_SQL} p JOIN {_POINTS_SQL} q ON p.vec_id <> q.vec_id GROUP BY 1, 2, 3) GROUP BY 1)""", "silhouette", "n")
def silhouette_given(spark, sf_dir):
    return cluster.silhouette(_points(spark, sf_dir), _FEATURES, "label", "vec_id")


_CH_SQL = f"""SELECT n, k, w AS inertia, b / w * (n - k) / (k - 1) AS calinski_harabasz FROM (SELECT count(*) AS n, sum({_distance('p', 'c')}) AS w FROM {_POINTS_SQL} p JOIN {_CENTROID_SQL} c USING (label)),
 (SELECT count(*) AS k, sum(n * ({_distance('c', 'g')})) AS b FROM {_CENTROID_SQL} c, (SELECT {', '.join(f'avg({x}) AS {x}' for x in _FEATURES)} FROM {_POINTS_SQL}) g)"""


@_query(_CH_SQL, "inertia calinski_harabasz", "n k")
def calinski_harabasz(spark, sf_dir):
    return cluster.calinski_harabasz(_points(spark, sf_dir), _FEATURES, "label")


_OWN_SQL = f"(SELECT c.*, s FROM {_CENTROID_SQL} c JOIN (SELECT p.label, avg(sqrt({_distance('p', 'c')})) AS s FROM {_POINTS_SQL} p JOIN {_CENTROID_SQL} c ON p.label = c.label GROUP BY 1) t USING (label))"


@_query(f"SELECT avg(r) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / sqrt({_distance('a', 'b')})) AS r FROM {_OWN_SQL} a JOIN {_OWN_SQL} b ON a.label <> b.label GROUP BY 1)", "davies_bouldin")
def davies_bouldin(spark, sf_dir):
    return cluster.davies_bouldin(_points(spark, sf_dir), _FEATURES, "label")


_PROFILE_SQL = _union([f"SELECT p.label AS label, '{x}' AS feature, avg({x}) AS mean, (avg({x}) - (SELECT avg({x}) FROM {_POINTS_SQL})) / (SELECT stddev_pop({x}) FROM {_POINTS_SQL}) AS z, count(*) AS n, count(*) / CAST((SELECT count(*) FROM {_POINTS_SQL}) AS DOUBLE) AS share FROM {_POINTS_SQL} p GROUP BY 1" for x in _FEATURES])


@_query(f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(z) DESC, feature) = 1 AS is_top FROM ({_PROFILE_SQL})", "mean z share", "label feature n is_top")
def cluster_profile(spark, sf_dir):
    return cluster.profile(_points(spark, sf_dir), _FEATURES, "label").select("label", "feature", "mean", "z", "n", "share", "is_top")


@_query("SELECT source, lang, n, n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1 AS is_top FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)", "share", "source lang n is_top")
def defect_composition(spark, sf_dir):
    return cluster.composition(_table(spark, sf_dir, "documents"), "source", "lang")


@_query()
def kmeans_select_k(spark, sf_dir):
    z, features = cluster.scaled(_points(spark, sf_dir), _FEATURES)
    return spark.createDataFrame(cluster.select_k(z, features, "vec_id"), "k long, silhouette double, inertia double, calinski_harabasz double, davies_bouldin double")


@_query()
def pca_2d(spark, sf_dir):
    z, features = cluster.scaled(_points(spark, sf_dir), _FEATURES)
    return cluster.pca_2d(z, features, "vec_id")


# --- models -----------------------------------------------------------------------------------

_MODEL_ROLES = QualitySchema(label="is_fail", unit="unit", run_numeric=("l_quantity", "l_discount", "l_tax"), batch_numeric=(), run_categorical=("l_linestatus",), batch_categorical=(), measured=())


def _modelled(spark, sf_dir) -> DataFrame:
    """The driver's numbers carry no signal, so the label is put in: large quantities of some suppliers fail."""
    line = _table(spark, sf_dir, "lineitem")
    unit = F.xxhash64(*line.columns).alias("unit")
    return line.select(unit, (F.col("l_quantity") + 10 * (F.col("l_suppkey") % 5) > 55).cast("int").alias("is_fail"), "l_quantity", "l_discount", "l_tax", "l_linestatus")


def _model(name: str) -> Query:
    def run(spark, sf_dir):
        parts = evaluate.split(_modelled(spark, sf_dir), "is_fail", ("unit",)).persist()
        train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
        (scored,), *_ = models.scored(name, train, [test], "is_fail", *models.prepare_features(parts, _MODEL_ROLES), ("unit",))
        m = evaluate.metrics(scored, "is_fail", "score", F.col("score") >= 0.5)
        parts.unpersist()
        return spark.createDataFrame([(name, m["n"], m["average_precision"], m["roc_auc"], m["f1"], m["accuracy"])], "model string, n long, average_precision double, roc_auc double, f1 double, accuracy double")

    return run


for _key, _name in (("logreg", "logistic_regression"), ("rf", "random_forest"), ("gbt", "hist_gradient_boosting"), ("mlp", "mlp_classifier")):
    _queries[_key] = _model(_name)


@_query()
def perm_importance(spark, sf_dir):
    rows = _modelled(spark, sf_dir).withColumn("score", F.col("l_quantity") / 60)
    got = models.permutation_importance(lambda d: d.withColumn("score", F.col("l_quantity") / 60), rows, "is_fail", ("l_quantity", "l_tax"), ("unit",))
    return spark.createDataFrame([(r["feature"], r["importance"]) for r in got], "feature string, importance double")


def _regressed(kind: str) -> Query:
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.col("n_chars").cast("double").alias("n_chars"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("spaces"), "lang")
        roles = QualitySchema(label="n_chars", run_numeric=("spaces",), batch_numeric=(), run_categorical=("lang",), batch_categorical=(), measured=("n_chars",))
        got = models.fit_target(rows, "n_chars", roles)["models"][kind]
        return spark.createDataFrame([(kind, got["n"], got["mae"], got["rmse"], got["r2"])], "model string, n long, mae double, rmse double, r2 double")

    return run


for _key, _name in (("linreg", "linear_regression"), ("gbt_reg", "gradient_boosting")):
    _queries[_key] = _regressed(_name)


# --- plot data -------------------------------------------------------------------------------------


def _corr_sql() -> str:
    cols, out = ("l_quantity", "l_discount", "l_tax"), []
    ranks = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols) + " FROM lineitem)"
    for i, a in enumerate(cols):
        out += [f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM {ranks}" for b in cols[i + 1 :]]
    return _union(out)


@_query(_corr_sql(), "rho", "a b")
def corr_matrix_spearman(spark, sf_dir):
    return plotdata.correlation_matrix(_table(spark, sf_dir, "lineitem"), ("l_quantity", "l_discount", "l_tax"))


def _box_sql() -> str:
    z = "(value - m) / s"
    picks = ", ".join(f"quantile_cont({z}, {q}) AS {n}" for q, n in ((0.0, "z_min"), (0.25, "z_q1"), (0.5, "z_median"), (0.75, "z_q3"), (1.0, "z_max")))
    return _union([f"SELECT '{c}' AS \"column\", is_fail, count(*) AS n, {picks} FROM (SELECT {c} AS value, is_fail, avg({c}) OVER () AS m, stddev_samp({c}) OVER () AS s FROM {_UNITS_SQL}) GROUP BY 2" for c in ("l_quantity", "l_discount")])


@_query(_box_sql(), "z_min z_q1 z_median z_q3 z_max", "column is_fail n")
def box_stats(spark, sf_dir):
    return plotdata.box_stats(_units(spark, sf_dir), ("l_quantity", "l_discount"), "is_fail")


@_query(f"SELECT CAST(least(floor(y * 20), 19) AS INT) AS bin, count(*) AS n FROM (SELECT avg(is_fail) AS y FROM {_UNITS_SQL} GROUP BY l_suppkey) GROUP BY 1", "", "bin n")
def hist_run_rate(spark, sf_dir):
    return plotdata.rate_histogram(integrate.build_run_level_table(_units(spark, sf_dir), ROLES))


@_query(f"SELECT score, tp / CAST(p AS DOUBLE) AS recall, fp / CAST(q AS DOUBLE) AS false_positive_rate, tp / CAST(tp + fp AS DOUBLE) AS precision FROM {_CURVE_SQL}", "score recall false_positive_rate precision")
def roc_pr_curves(spark, sf_dir):
    return plotdata.curves(_units(spark, sf_dir), "is_fail", "score")


@_query()
def synthetic_tables(spark, sf_dir):
    """Row counts of the made-up factory."""
    from .sources import synth

    made, _ = synth.generate_all(spark)
    return spark.createDataFrame([(name, df.count()) for name, df in sorted(made.items())], "name string, n long")


@_query(f"""SELECT "column", ks, greatest(0, least(1, 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * ks * ks * (CAST(n1 AS DOUBLE) * n2 / (n1 + n2)))))) AS p_value
 FROM ({_union([_ks_sql(x) for x in _DRIFT])}), range(1, 101) r(k) GROUP BY "column", ks""", "ks p_value", "column")
def ks_p_values(spark, sf_dir):
    rows = [(r["column"], r["ks"], special.ks_p(r["ks"], r["n1"], r["n2"])) for r in ks_statistic(spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "column string, ks double, p_value double")
