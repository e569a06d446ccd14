"""Every query of the catalogue against its SQL, on the smallest library."""

import decimal
import glob
import os

import pytest

from lectern.plans import catalog

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, (float, decimal.Decimal, int)) and not isinstance(v, bool):
        return round(float(v), 6)
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, ROOT)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE:
        assert rows
        return
    found = duck.sql(catalog.ORACLE[name])
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns)
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in found.fetchall()), key=repr)
