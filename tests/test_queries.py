"""Every registered query of the core with SQL gives what its SQL gives, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from citeloom.plans.registry import oracle_sql, queries

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables aren't here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in TABLES.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, str(TABLES))
    columns = sorted(df.columns)
    found = duck.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == want
