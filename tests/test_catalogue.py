"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from stationlake import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=key)
    have = sorted((tuple(r[c] for c in sorted(names)) for r in got), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a == pytest.approx(b, abs=2e-6) if any(isinstance(x, float) for x in a) and None not in a else a == b
