"""The queries that have SQL, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from voxelloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, small, name):
    con = duckdb.connect()
    for p in sorted(Path(small).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    result = con.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    got = queries.QUERIES[name](spark, small).select(*names)
    a, b = sorted(map(tuple, got.collect())), sorted(result.fetchall())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(math.isclose(u, v, abs_tol=1e-3) if isinstance(u, float) else u == v for u, v in zip(x, y, strict=True)), (x, y)
