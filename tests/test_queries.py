"""Every registered query of the library against its SQL in DuckDB: queries round, so values must be equal. PANELYTE_SF
names another scale (the default is the smallest)."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from panelyte.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sf(sf):
    return sf.replace("sf0.001", os.environ.get("PANELYTE_SF", "sf0.001"))


@pytest.fixture(scope="module")
def threads():
    return 8


@pytest.fixture(scope="module")
def con(sf, threads):
    c = duckdb.connect(config={"threads": threads})
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(v) + 0.0
    return v if v is None or isinstance(v, (int, float)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-12 * max(1, abs(x)) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name in ORACLES:
        done = con.execute(ORACLES[name])
        names, want = [d[0] for d in done.description], done.fetchall()
        assert sorted(df.columns) == sorted(names)
        assert same(rows(df.columns, got), rows(names, want))


def test_hit_rates_do_not_depend_on_rounding(con):
    """An IC that is zero but for rounding counts alike whatever the order of a sum."""
    told = []
    for n in (1, 4, 8):
        con.execute(f"set threads = {n}")
        told.append(rows(*(lambda d: ([c[0] for c in d.description], d.fetchall()))(con.execute(ORACLES["ic_momentum_summary"]))))
    assert told[0] == told[1] == told[2]


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
