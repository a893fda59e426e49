"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def _canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.8g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, oracle, name):
    found = QUERIES[name](spark, FOLDER)
    cursor = oracle.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    ordered = sorted(columns)
    expected = [dict(zip(columns, r)) for r in cursor.fetchall()]
    got = [r.asDict() for r in found.collect()]

    def table(rows):
        return sorted(tuple(_canonical(r[c]) for c in ordered) for r in rows)

    assert table(got) == table(expected)


def test_entry_returns_rows(spark):
    report = entry_point.entry(spark)
    assert report.count() == 32 and "mape_percent" in report.columns


def test_every_sql_text_has_a_query():
    assert set(SQL) <= set(QUERIES)
