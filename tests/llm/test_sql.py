"""Queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.llm import entry

DATA = "/root/testdata/sf0.001"


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.QUERIES[name](spark, DATA)
    expected = duck.sql(entry.ORACLE_SQL[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), expected.columns)
