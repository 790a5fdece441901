"""Where the query modules register: a function of (spark, sf_dir), and the SQL that an independent engine checks it by."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.context import EngineContext
from lodestone.operators import EngineFrame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Tables:
    """The tables of a folder, each read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.context, self.sf_dir = EngineContext(spark), sf_dir

    def __getattr__(self, name: str) -> EngineFrame:
        return self.context.read_parquet(f"{self.sf_dir}/{name}.parquet")


def frame_query(name: str, oracle: str | None):
    """Registers a function from Tables to an EngineFrame or DataFrame."""

    def add(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            return out.df if isinstance(out, EngineFrame) else out

        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL that both engines run; tables stand in braces."""
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return spark.sql(text, **{n: getattr(t, n).df for n in used})

    QUERIES[name] = query
    ORACLES[name] = oracle or re.sub(r"\{(\w+)\}", r"\1", text)
