"""What several operators share: table loading, shared storage and Arrow mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import scratch

#: ASCII white space of the word definition [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that are Python objects at any one time.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: The session's setting for rows of a batch, and its default.
BATCHES, DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Batches of ROWS rows from now on, unless the session has its own setting: rows are texts, and 10,000 of them fill an executor's memory on both sides of the pipe."""
    if spark.conf.get(BATCHES) == DEFAULT:
        spark.conf.set(BATCHES, str(ROWS))


def release() -> None:
    """Gives freed memory back to the system: workers are used again, by other stages too, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """fn on every Arrow batch of df, ROWS rows at a time; done at the end of each task drops what fn has kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                out = fn(b.slice(i, ROWS))
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
                out = None
        b = None
        if done is not None:
            done()
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    """Texts with null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
