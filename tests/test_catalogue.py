"""Every query with SQL gives what DuckDB gives, in columns, types of value and rows."""

from __future__ import annotations

import duckdb
import pytest

from tracelab.plans import catalogue, cells, lanes, records, trials  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def shown(v) -> str:
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(shown(r[c]) for c in order) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs_twice_alike(spark, sf, name):
    """Determinism of what SQL can't express."""
    first, second = (sorted(map(str, catalogue.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert first == second


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
