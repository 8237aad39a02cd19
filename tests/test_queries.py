"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import oracle, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    expected = duck.sql(oracle.ORACLE_SQL[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), expected.columns)


def test_every_batch_query_has_sql():
    assert set(queries.QUERIES) - set(oracle.ORACLE_SQL) == {"job_dedupe_stream"}


def test_job_stream_keeps_one_row_a_job(spark):
    out = queries.job_dedupe_stream(spark, DATA)
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert 0 < out.count() <= events.select("user_id", "event_type").distinct().count()
    assert out.count() == out.select("user_id", "event_type").distinct().count()
