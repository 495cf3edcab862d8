"""Every query with SQL, on sf0.001, against that SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from loomstone import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted(repr([norm(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)]) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == want


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES


def test_hier_search(spark):
    rows = catalog.QUERIES["hier_search"](spark, SF).collect()
    assert {r.kind for r in rows} == {"theme", "semantic", "episodic"}
