"""Every query with SQL equals DuckDB on the smallest tables; the others return rows."""

import glob
import math
import os

import duckdb
import pytest

import workload
import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _text(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query(name, spark, duck):
    df = workload.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in workload.ORACLES:
        assert rows
        return
    found = duck.execute(workload.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, rows) == _rows(names, found.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    out = contract.entry(spark)
    assert out.count() > 0
    assert {"l_returnflag_A", "l_linestatus_O", "l_quantity"} <= set(out.columns)
