"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from mesaquery.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    r = duck.sql(catalogue.ORACLES[name])
    at = [r.columns.index(c) for c in cols]
    assert sorted(r.columns) == cols
    assert got == sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
