"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from helixlake.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(rows):
    return sorted(tuple(str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    out = QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) AS o").fetchall()
    assert normal(map(tuple, out.select(columns).collect())) == normal(want)


def test_entry_is_complete(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
