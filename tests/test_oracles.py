"""Every query with SQL against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from voxelloom.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in sorted(Path(small).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small)
    result = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(names)
    a, b = canonical(map(tuple, got.collect()), got.columns), canonical(result.fetchall(), names)
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b, strict=True):
        assert all(math.isclose(u, v, abs_tol=2e-6) if isinstance(u, float) else u == v for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_flagship(spark, small):
    assert catalog.flagship(spark, small).count() == 500
