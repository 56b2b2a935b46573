"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLES:
        return
    cur = duck.execute(ORACLES[name])
    named = [d[0] for d in cur.description]
    assert sorted(named) == cols
    want = sorted(str([plain(dict(zip(named, r, strict=True))[c]) for c in cols]) for r in cur.fetchall())
    assert rows == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_depend_on_partitions(spark, monkeypatch):
    from lectern.plans import search, structure

    for module, name in ((search, "bm25_terms"), (structure, "running_heads")):
        one = sorted(map(str, QUERIES[name](spark, SF).collect()))
        load = module.load
        monkeypatch.setattr(module, "load", lambda s, d, t, load=load: load(s, d, t).repartition(7))
        assert sorted(map(str, QUERIES[name](spark, SF).collect())) == one
        monkeypatch.undo()
