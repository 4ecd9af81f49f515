"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from kinelake import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v + 0.0, 7) if isinstance(v, float) else v


def in_order(rows):
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", 0 if x is None else x) for x in t))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_and_sql_agree(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = in_order(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = in_order(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["user_id", "start", "end"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
