"""Every registered query with SQL gives the rows of that SQL (smallest tables)."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, close, rows_of

D = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(SQL[name])
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert cols == want_cols
    assert len(got) == len(want)
    assert all(all(close(x, y) for x, y in zip(a, b)) for a, b in zip(got, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
