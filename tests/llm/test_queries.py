"""Every registered query of the subpackage over the smallest tables, against its SQL where it has some."""

import duckdb
import pytest

from bytefold.llm import queries

TABLES = "documents embeddings conversations labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [sorted(columns), sorted((tuple(v[i] for i in order) for v in values), key=repr)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf, name):
    found = queries.QUERIES[name](spark, sf)
    got = [tuple(r) for r in found.collect()]
    if name in queries.ORACLE_SQL:
        asked = duck.execute(queries.ORACLE_SQL[name])
        assert rows(found.columns, got) == rows([c[0] for c in asked.description], asked.fetchall())
    else:
        ids = {r[found.columns.index("doc_id")] for r in got}
        assert ids == {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}
