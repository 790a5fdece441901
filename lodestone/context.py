"""The entry point: tables by name, files by path, SQL by text, over one Spark session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestone import sources
from lodestone.operators import EngineFrame
from lodestone.plans import Job, submit
from lodestone.types import Schema

# fixed values: settings with a name of their own
SETTINGS = {"batch.size": "spark.sql.execution.arrow.maxRecordsPerBatch"}
FILE_TYPES = {"csv": "csv", "parquet": "parquet", "ndjson": "json", "json": "json"}


class EngineContext:
    """settings: Spark's own with dots as __ (``spark__sql__shuffle__partitions=64``), or a name in SETTINGS. Tables stay registered for the session."""

    def __init__(self, spark: SparkSession | None = None, **settings):
        self.spark = spark or SparkSession.builder.getOrCreate()
        for k, v in settings.items():
            k = k.replace("__", ".")
            self.spark.conf.set(SETTINGS.get(k.replace("_", "."), k), str(v).lower() if isinstance(v, bool) else str(v))

    def read_csv(self, path: str, **options) -> EngineFrame:
        return EngineFrame(sources.read_csv(self.spark, path, **options))

    def read_tbl(self, path: str, schema, file_extension: str = ".tbl") -> EngineFrame:
        return EngineFrame(sources.read_tbl(self.spark, path, schema, file_extension))

    def read_parquet(self, path: str) -> EngineFrame:
        return EngineFrame(sources.read_parquet(self.spark, path))

    def read_json(self, path: str, schema) -> EngineFrame:
        return EngineFrame(sources.read_json(self.spark, path, schema))

    def register_table(self, name: str, frame: EngineFrame | DataFrame) -> None:
        if not name:
            raise ValueError("a table needs a name")
        (frame.df if isinstance(frame, EngineFrame) else frame).createOrReplaceTempView(name)

    def register_csv(self, name: str, path: str, **options) -> None:
        self.register_table(name or "", self.read_csv(path, **options)) if name else self.register_table("", None)

    def register_parquet(self, name: str, path: str) -> None:
        self.register_table(name or "", self.read_parquet(path)) if name else self.register_table("", None)

    def table(self, name: str) -> EngineFrame:
        return EngineFrame(self.spark.table(name))

    def create_external_table(self, name: str, location: str, file_type: str, has_header: bool = False, schema: Schema | None = None, delimiter: str = ",") -> EngineFrame:
        """A view over files; it lasts as long as the session."""
        if file_type.lower() not in FILE_TYPES:
            raise ValueError(f"no file type is named {file_type!r}")
        if not re.fullmatch(r"\w+", name or ""):
            raise ValueError("a table needs a plain name")
        quoted = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
        columns = f" ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.spark)})" if schema else ""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name}{columns} USING {FILE_TYPES[file_type.lower()]} OPTIONS (path '{quoted(sources.located(location))}', header '{str(has_header).lower()}', sep '{quoted(delimiter)}')")
        return self.table(name)

    def empty(self, schema=None, produce_one_row: bool = False) -> EngineFrame:
        return EngineFrame(sources.empty(self.spark, schema or "", produce_one_row))

    def from_batches(self, batches, projection: list[str] | None = None) -> EngineFrame:
        return EngineFrame(sources.from_batches(self.spark, batches, projection))

    def file_metadata(self, path: str, file_type: str = "parquet") -> sources.FileMetadata:
        return sources.file_metadata(self.spark, path, file_type)

    def sql(self, text: str, **variables) -> EngineFrame:
        """variables: values of the scalar variables (@name) in text."""
        marked = re.sub(r"('(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`)|@(\w+)", lambda m: m[1] or f":{m[2]}", text) if variables else text
        return EngineFrame(self.spark.sql(marked, args=variables) if variables else self.spark.sql(text))

    def submit(self, query: EngineFrame | str) -> Job:
        return submit(self.sql(query).df if isinstance(query, str) else query.df)
