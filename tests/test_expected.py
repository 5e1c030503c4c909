"""Every registered query against its DuckDB text."""

import decimal
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.expected.texts import EXPECTED
from millrace.plans.registered import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return str(value) if isinstance(value, decimal.Decimal) else value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_each_query_has_an_expected_text():
    assert set(QUERIES) == set(EXPECTED)
    assert set(EXPECTED) <= set(entry.oracle_sql()) <= set(entry.queries())  # further packages may bring queries without


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
