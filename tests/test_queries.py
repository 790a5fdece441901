"""Every registered query of the engine against its SQL in an independent engine."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodestone.queries import ORACLES, QUERIES, flagship
from lodestone.queries.registry import TABLES


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{v:.12g}")
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), [tuple(cell(r[i]) for i in order) for r in rows]


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    columns, rows = table(df.columns, df.collect())
    found = oracle.execute(ORACLES[name])
    want_columns, want = table([d[0] for d in found.description], found.fetchall())
    assert columns == want_columns
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    if name.startswith("sort_"):
        assert rows == want
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() >= 1


def test_names_follow_the_inventory():
    assert {f"tpch_q{n:02}" for n in range(1, 23) if n != 15} <= set(QUERIES)
    assert len([n for n in QUERIES if n.startswith("fn_")]) == 33
