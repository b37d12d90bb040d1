"""Every catalogued query beside its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spindrift.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def coarse(value):
    if isinstance(value, float):
        return f"{value:.3g}"
    return tuple(map(coarse, value)) if isinstance(value, (list, tuple)) else value


def rows(tuples):
    return sorted((tuple(r) for r in tuples), key=lambda r: str(tuple(map(coarse, r))))


def agree(a, b):
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(agree, a, b))
    if isinstance(a, float) and isinstance(b, (float, int)):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a)) or (a != a and b != b)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    if name not in catalog.ORACLE_SQL:
        assert df.columns
        return
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {names} FROM ({catalog.ORACLE_SQL[name]})")
    assert len(con.sql(catalog.ORACLE_SQL[name]).columns) == len(columns)
    want = rows(want.fetchall())
    assert len(got) == len(want)
    assert not [(g, w) for g, w in zip(got, want, strict=True) if not agree(g, w)][:3]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
