"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from tideline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    found = duck.execute(ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = ordered([tuple(r[at.index(c)] for c in columns) for r in found.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and y is not None else x == y


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    QUERIES[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
