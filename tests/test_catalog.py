import math
import os

import duckdb
import pytest

from driftline import catalog

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.SQL:
        assert got
        return
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    want_rows = rows_of(want.fetchall(), want.columns)
    got_rows = rows_of(got, df.columns)
    assert got_rows == want_rows
    assert got_rows
