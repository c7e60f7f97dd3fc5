"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from rankloom.plans.oracles import ORACLES
from rankloom.plans.registry import QUERIES

NO_SQL: set[str] = set()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def test_all_but_the_named_have_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    if name in NO_SQL:
        assert rows
        return
    cur = con.execute(entry.oracle_sql()[name])
    assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["job_id", "rank", "app_id", "score", "group_rows"] and df.count() > 0
