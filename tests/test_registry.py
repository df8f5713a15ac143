"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from folioscope.plans import registry

HERE = registry.QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def value(v):
    import math

    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v


def frame(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([value(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    df = HERE[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    rel = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = frame(df.columns, got), frame(names, want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) <= 2e-4 * max(1, abs(u)) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(HERE) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    df = HERE[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(HERE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
