"""Every registered query against its SQL, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from weftline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = con.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
