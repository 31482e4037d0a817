"""Each query that has SQL gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from pagemill import catalog


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, sf_dir, duck):
    df = catalog.queries()[name](spark, sf_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(left) == len(right)
    off = [(a, b) for a, b in zip(left, right, strict=True) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4 for x, y in zip(a, b, strict=True))]
    assert not off, off[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(name, spark, sf_dir):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
