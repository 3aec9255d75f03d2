"""Every registered query against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def oracle(small):
    connection = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, oracle, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = oracle.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["prompt_id", "turn", "reward", "advantage"] and df.count() > 0
