"""Every query with SQL must equal DuckDB's answer over the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__

ROOT = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, duck, name):
    result = __spark_entry__.queries()[name](spark, ROOT)
    columns = sorted(result.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in result.collect()]
    answer = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = [tuple(plain(row[i]) for i in places) for row in answer.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())))
def test_runs_without_sql(spark, name):
    result = __spark_entry__.queries()[name](spark, ROOT)
    assert len(set(result.columns)) == len(result.columns)
    assert result.count() > 0


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
