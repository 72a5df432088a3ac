"""Registered queries against their SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from lodestat import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted([tuple("" if v is None or v != v else round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", ["perf_agg_join", "null_profile", "clean_table", "out_of_range", "psi", "mann_whitney_u", "chi_square", "kruskal_h", "bh_fdr", "mann_kendall", "backtest", "average_precision", "strat_split_sizes", "silhouette_given", "box_stats"])
def test_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(db.sql(f"SELECT {picked} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_registered_queries_keep_the_operators_defaults(spark):
    import inspect
    import re

    from lodestat import catalog
    from lodestat.operators import models

    own = inspect.getsource(catalog)
    own = own.replace("n_perm=1)", "")  # the statistic alone, which no permutation changes
    assert not re.search(r"\b(trees|rounds|repeats|n_perm|starts)=[0-9]|information=False", own)
    assert models.classifier("random_forest", 100, 4).getMaxDepth() == 30


def test_large_doubles_keep_their_size_when_rounded(spark, db):
    """4e17 rows' ties, 1.4e14 of U: floor() to a long stopped at 9.22e12."""
    many = [4.3e17, 1.4e14 + 0.5, 9.3e12, -4.3e17, 1234567.1234567, -0.0000014, 0.0]
    got = [r["x"] for r in catalog.rounded(spark.createDataFrame([(x,) for x in many], "x double")).collect()]
    assert got == [db.sql(f"SELECT CAST(floor(CAST({x!r} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS DOUBLE)").fetchall()[0][0] for x in many]
    assert got[0] == pytest.approx(4.3e17, rel=1e-12)
    whole = catalog.rounded(spark.createDataFrame([(float("inf"),), (float("nan"),), (None,)], "x double")).collect()
    assert whole[0]["x"] == float("inf") and whole[1]["x"] != whole[1]["x"] and whole[2]["x"] is None
