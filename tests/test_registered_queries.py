"""Every registered query against its SQL on the smallest tables."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verification.compare import rows_of

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    # Operators for training data are compared with brute force instead.
    without = {name for name in set(QUERIES) - set(SQL) if not re.match(r"op\d+_|pipeline$", name)}
    assert not without


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = tables.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got.total() > 0 and got == rows_of(columns, result.fetchall())


def test_routes_are_as_expected(spark, sf_dir):
    assert QUERIES["question_route"](spark, sf_dir).filter("not as_expected").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
