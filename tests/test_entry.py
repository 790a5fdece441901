"""The driver's contract."""

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).columns


def test_registries():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(q) for q in e.queries().values())
