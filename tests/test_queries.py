"""Every registered query next to its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from pplscope.checks.registry import ORACLE as SQL, QUERIES
from tools.compare import TABLES, rows

NO_SQL = {"loo_predictions", "loo_metrics", "nonzero_coefficients"}


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def test_only_the_solver_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    df = QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    # With no useful chunk the regression keeps only its intercept.
    assert got or name == "nonzero_coefficients"
    if name in SQL:
        result = db.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, result.fetchall())


def test_entry_offers_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "text_id", "chunk_id", "gamma", "chunk_text"] and df.count() == 20
