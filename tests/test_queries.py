"""Every query of the daily-series engine against its DuckDB statement."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import registry

SF = Path("/root/testdata/sf0.01")  # at sf0.001 hardly any day has all assets, so aligned results are empty
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = db.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    theirs = [tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()]
    assert sorted(names) == cols
    assert sorted(ours, key=str) == sorted(theirs, key=str)
    assert ours


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)
    assert entry.entry(spark).count() == 5


ALIGNED = ("aligned_returns", "column_coverage", "correlation_pearson", "correlation_spearman", "crypto_macro_summary", "rolling_correlation", "beta", "regime_correlation")


@pytest.mark.parametrize("name", ALIGNED)
def test_aligned_queries_read_each_table_twice_at_most(spark, name):
    plan = registry.QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert 2 <= plan.count("FileScan parquet") <= 4 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_moving_averages_read_their_table_once(spark):
    plan = registry.QUERIES["moving_averages"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("sf, orders", [("sf0.01", "(2, 1) (1, 1) (1, 1) (2, 1) (1, 1)"), ("sf0.1", "(0, 2) (0, 1) (1, 1) (0, 1) (0, 1)")])
def test_orders_are_those_of_the_exact_simplex_search(spark, sf, orders):
    rows = registry.QUERIES["forecast"](spark, str(SF.parent / sf)).orderBy("symbol").select("p", "q").collect()
    assert " ".join(f"({r.p}, {r.q})" for r in rows) == orders
