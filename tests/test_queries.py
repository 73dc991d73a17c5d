"""Every query of the catalogue against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from relaynote.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    cols = sorted(rows.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in rows.collect())
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).collect() is not None
