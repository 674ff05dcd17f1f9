"""Every registered query against its SQL in DuckDB; those without SQL give rows."""

from __future__ import annotations

import duckdb
import pytest

from vortiq import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = own.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def same(x):
    return round(x, 5) if isinstance(x, float) else x.item() if hasattr(x, "item") else x


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, sf, duck, name):
    df = own.queries()[name](spark, sf)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    left = sorted((tuple(same(r[c]) for c in order) for r in rows), key=str)
    right = sorted((tuple(same(r[columns.index(c)]) for c in order) for r in got.fetchall()), key=str)
    assert left == right


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 32
    assert set(entry.oracle_sql()) <= set(entry.queries())
