"""Every query that has SQL against DuckDB over the same small tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

from inkwell.plans import catalog, ingested

QUERIES, SQL = catalog.QUERIES | ingested.QUERIES, catalog.SQL | ingested.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(table, columns):
    def plain(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else v

    return sorted(repr([plain(v) for v in r]) for r in ([row[c] for c in columns] for row in table))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = [r.asDict() for r in df.collect()]
    assert got
    if name in SQL:
        rel = duck.execute(SQL[name])
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(df.columns)
        want = [dict(zip(columns, r, strict=True)) for r in rel.fetchall()]
        assert rows(got, sorted(columns)) == rows(want, sorted(columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["path", "title", "score", "url", "snippet", "project", "published", "source_type"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
