"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from stepweave.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for name in os.listdir(SF):
        out.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return out


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    rows = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*order).collect()) == rows


def test_entry_imports_and_lists():
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.queries())
