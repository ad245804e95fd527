"""Every registered query of the engine runs at the smallest scale; those with SQL equal DuckDB."""

import os

import pytest

from skyloom import fixtures, queries

DATA = "/root/testdata/sf0.001"


def value(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in queries.ORACLES:
        return
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(value(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_module():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name, cell, chans", [("q40", "beam = 0 and chan = 0", 7), ("q41", "beam = 0 and chan = 0", 7), ("q62", "chan = 0", 7), ("q64", "chan = 1", 7), ("q74", "chan < 3", 7), ("q77", "beam = 0 and chan = 0", 7), ("q83", "chan = 2", 7), ("q84", "chan = 2", 7)])
def test_whole_query_covers_every_cell(spark, name, cell, chans):
    one, whole = queries.QUERIES[name](spark, DATA), queries.QUERIES[f"{name}_all"](spark, DATA).cache()
    assert whole.select("chan").distinct().count() == chans
    if "beam" in whole.columns:
        assert whole.select("beam").distinct().count() == 4
    keys = [c for c in one.columns if c in ("vis_id", "chan", "beam", "y", "x")]
    want = {tuple(r[k] for k in keys): r for r in one.collect()}
    got = [r for r in whole.where(cell).collect() if name != "q74" or tuple(r[k] for k in keys) in want]
    assert {tuple(r[k] for k in keys) for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        for c in set(one.columns) - set(keys):
            assert r[c] == pytest.approx(want[tuple(r[k] for k in keys)][c], rel=1e-6, abs=1e-3)
    whole.unpersist()
