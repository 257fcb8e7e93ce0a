"""Queries that have SQL against DuckDB, and the entry that lists them."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

from inkwell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    rel = con.execute(queries.SQL[name])
    columns = sorted(d[0] for d in rel.description)
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == columns
    order = [[d[0] for d in rel.description].index(c) for c in columns]
    assert sorted(repr([r[k] for k in order]) for r in rel.fetchall()) == sorted(repr([r[c] for c in columns]) for r in df.collect())


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
