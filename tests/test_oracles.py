"""Every query against its SQL on the smallest tables; queries without SQL must give stable rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from strandline.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    ours = sorted(repr(tuple(plain(v) for v in r)) for r in got.select(*columns).collect())
    quoted = ", ".join('"' + c + '"' for c in columns)
    theirs = sorted(repr(tuple(plain(v) for v in r)) for r in con.sql(f"select {quoted} from ({ORACLES[name]})").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_repeat(spark, name):
    first, second = (sorted(map(repr, QUERIES[name](spark, DATA).collect())) for _ in range(2))
    assert first == second and first


def test_names_are_there():
    assert len(QUERIES) >= 120 and set(ORACLES) <= set(QUERIES)
