"""Registry of the engine's queries with the SQL that an independent engine checks them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.queries import corpus, files, relational, scalars  # noqa: F401  they register
from lodestone.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing summary by return flag and line status."""
    return QUERIES["tpch_q01"](spark, sf_dir)
