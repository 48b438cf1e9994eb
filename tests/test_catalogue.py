"""Each query with SQL against DuckDB on the same tables."""

import datetime

import duckdb
import pytest

from bytefold import catalogue, catalogue_tables

QUERIES = catalogue.QUERIES | catalogue_tables.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | catalogue_tables.ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return [sorted(columns), sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    found = QUERIES[name](spark, sf)
    asked = duck.execute(ORACLE_SQL[name])
    want = rows([c[0] for c in asked.description], asked.fetchall())
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and not set(catalogue.QUERIES) & set(catalogue_tables.QUERIES)


def test_entry_and_collections(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["unit", "blocks", "edges"]
    assert set(QUERIES) <= set(entry.queries())
