"""Names whose case number has more than four digits have no channel number: scans end with every file accounted for."""

import duckdb
import pytest

from voxelloom.plans import catalog
from voxelloom.sources import scan

FILES = ["case_0001_0000.nii.gz", "case_0001_0001.nii.gz", "case_0002_0001.nii.gz", "case_12345_0000.nii.gz", "case_12345_0001.nii.gz", "case_0001.nii.gz"]


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """Conversations 9980 to 10019 of one to three turns."""
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(c, t) for c in range(9980, 10020) for t in range(1 + c % 3)], "conv_id long, turn long").write.parquet(f"{d}/conversations.parquet")
    return d


def by_sql(d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet/*.parquet' WHERE conv_id < 10000")
    return sorted(con.execute(catalog.ORACLES[name]).fetchall())


def unnumbered():
    return [f"case_{c}_{t:04d}" for c in range(10000, 10020) for t in range(1 + c % 3)]


def test_contiguity_errors_of_long_numbers(spark, long):
    files = spark.createDataFrame([(n,) for n in FILES], "name string")
    got = sorted((r.case_id, r.n, r.k) for r in scan.contiguity_errors(files).collect())
    assert got == [("case_0001", 1, 0), ("case_0002", 1, 1), ("case_12345_0000", 1, 0), ("case_12345_0001", 1, 0)]
    rows = sorted(map(tuple, catalog.QUERIES["scan_contiguity_errors"](spark, long).collect()))
    assert rows == sorted(by_sql(long, "scan_contiguity_errors") + [(name, 1) for name in unnumbered()])


def test_cases_of_long_numbers_are_refused_by_name(spark):
    files = spark.createDataFrame([(n, n) for n in FILES[:5]], "name string, path string")
    assert {r.case_id: r.paths for r in scan.scan_cases(files.limit(2)).collect()} == {"case_0001": FILES[:2]}
    with pytest.raises(Exception, match="no channel number.*case_12345_000"):
        scan.scan_cases(files).collect()


def test_channels_of_long_numbers(spark, long):
    rows = sorted(map(tuple, catalog.QUERIES["scan_multi"](spark, long).collect()), key=str)
    assert rows == sorted(by_sql(long, "scan_multi") + [(name, None) for name in unnumbered()], key=str)
