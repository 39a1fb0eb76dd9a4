"""Every query with SQL gives the rows of that SQL; every other one runs."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from barloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x != x:
            return ""
        return repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = registry.QUERIES[name](spark, sf_dir)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.toPandas()
    if name in registry.ORACLES:
        want = oracle.sql(registry.ORACLES[name]).df()
        assert sorted(rows.columns) == sorted(want.columns)
        assert plain(rows) == plain(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_empty_tables(spark, sf_dir, tmp_path):
    """Queries over tables without rows give no rows (or only constant ones), and no error."""
    for t in ("events", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("bars_h1", "macd", "cond_alligator", "signal_score", "candle_patterns", "adaptive_weights", "backtest_metrics", "holdout_gates", "recommendation_outcomes", "ledger_monthly", "support_resistance_levels"):
        assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0, name
