"""Every query with SQL gives the SQL's rows on the smallest tables; every other one runs."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
EMPTY_IS_FINE = {"benchmark_regression", "secret_line_scan", "secret_match_count", "anomaly_rules", "loop_detect", "coverage_gap", "patched_findings"}


def canon(pdf):
    out = []
    for row in pdf[sorted(pdf.columns)].itertuples(index=False):
        out.append(tuple("NULL" if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v) else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = db.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
    assert len(got) or name in EMPTY_IS_FINE


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
