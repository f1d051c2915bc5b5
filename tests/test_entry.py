"""Every core query against its SQL, at the smallest scale; those without SQL against loops or for their rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from heliospark import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(core.SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(str([plain(v) for v in r]) for r in duck.sql(f"select {', '.join(cols)} from ({core.SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_has_rows(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_routes_agree_with_rounds_of_joins(spark):
    from heliospark.operators import search

    e, n, shade_of, table = core._grid(spark, SF)
    city = search.City.of(e, n, shade_of, table)
    got = {r["req_id"]: r["cost"] for r in core.route_relaxed(spark, SF).collect()}
    asked = core._far(n).collect()
    at = {k: i for i, k in enumerate(city.nodes.tolist())}
    for r in asked:
        steps = city.walk(city.prices(r["alpha"]), city.clock, at[r["origin"]], at[r["goal"]], 490.0, guide=False)
        assert (r["req_id"] in got) == (steps is not None)
        if steps:
            assert got[r["req_id"]] == pytest.approx(sum(float(city.costs(r["alpha"])[s, x]) for x, s in steps), rel=1e-6)
