"""Files and batches in, files out."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.types import Schema

# fixed values: compressions of Parquet output; those with a codec class need a jar that Spark doesn't bring
COMPRESSIONS = ("none", "snappy", "brotli", "gzip", "lz4", "lzo", "zstd")
CODECS = {"brotli": "org.apache.hadoop.io.compress.BrotliCodec", "lzo": "com.hadoop.compression.lzo.LzoCodec"}


def located(path: str) -> str:
    """Local paths made absolute; others as they are."""
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset a temporary one, which only a local session can use."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("executors need a shared folder: set spark.checkpoint.dir")
        at = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under the name of the application that owns it."""
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _struct(schema: Schema | T.StructType | str | None) -> T.StructType | str | None:
    return schema.spark if isinstance(schema, Schema) else schema


def read_csv(spark: SparkSession, path: str, has_header: bool = True, delimiter: str = ",", file_extension: str = ".csv", schema: Schema | T.StructType | str | None = None, schema_infer_max_records: int = 1000) -> DataFrame:
    """Delimited text. Without a schema, types come from the first records alone: one small job, never a pass over the data."""
    if len(delimiter) != 1 or ord(delimiter) > 127:
        raise ValueError("the delimiter must be one ASCII character")
    path, schema = located(path), _struct(schema)
    reader = spark.read.option("header", has_header).option("sep", delimiter)
    if file_extension:
        reader = reader.option("pathGlobFilter", f"*{file_extension}")
    if schema is None:
        sample = spark.read.option("pathGlobFilter", f"*{file_extension}").text(path) if file_extension else spark.read.text(path)
        lines = [r[0] for r in sample.limit(schema_infer_max_records + int(has_header)).collect()]  # bounded by the argument
        if not lines:
            raise ValueError(f"no records to infer a schema from in {path}")
        schema = spark.read.option("header", has_header).option("sep", delimiter).option("inferSchema", True).csv(spark.sparkContext.parallelize(lines, 1)).schema
    return reader.schema(schema).csv(path)


def read_tbl(spark: SparkSession, path: str, schema: Schema | T.StructType | str, file_extension: str = ".tbl") -> DataFrame:
    """Text with | between and after the fields, without a header."""
    return read_csv(spark, path, False, "|", file_extension, schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(located(path))


def read_json(spark: SparkSession, path: str, schema: Schema | T.StructType | str) -> DataFrame:
    """An object a line."""
    return spark.read.schema(_struct(schema)).json(located(path))


def empty(spark: SparkSession, schema: Schema | T.StructType | str = "", produce_one_row: bool = False) -> DataFrame:
    """No row, or a row of no columns to compute constants on."""
    return spark.range(1).select() if produce_one_row else spark.createDataFrame([], _struct(schema) or T.StructType([]))


def from_batches(spark: SparkSession, batches: list[pa.RecordBatch] | pa.Table, projection: list[str] | None = None) -> DataFrame:
    table = batches if isinstance(batches, pa.Table) else pa.Table.from_batches(batches)
    return spark.createDataFrame(table.select(projection) if projection else table)


@dataclass(frozen=True)
class FileMetadata:
    schema: T.StructType
    files: tuple[str, ...]


def file_metadata(spark: SparkSession, path: str, file_type: str = "parquet") -> FileMetadata:
    if file_type.lower() != "parquet":
        raise NotImplementedError(f"metadata of {file_type} files")
    df = read_parquet(spark, path)
    return FileMetadata(df.schema, tuple(sorted(df.inputFiles())))


def write_csv(df: DataFrame, path: str, has_header: bool = True, delimiter: str = ",") -> None:
    df.write.option("header", has_header).option("sep", delimiter).csv(located(path))


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    if compression not in COMPRESSIONS:
        raise ValueError(f"no compression is named {compression!r}")
    if compression in CODECS:
        try:
            df.sparkSession._jvm.org.apache.spark.util.Utils.classForName(CODECS[compression], True, False)
        except Exception as e:
            raise ValueError(f"{compression} needs {CODECS[compression]}, which isn't on the class path") from e
    df.write.option("compression", compression).parquet(located(path))


def write_tbl(df: DataFrame, path: str) -> None:
    """Text with | after every field; null as nothing. The files end in .txt."""
    df.select(F.concat(*[F.concat(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|")) for c in df.columns]).alias("value")).write.text(located(path))


def write_json(df: DataFrame, path: str) -> None:
    """An object a line."""
    df.write.json(located(path))


def to_ipc(df: DataFrame) -> DataFrame:
    """(rows, payload): the partitions of df as Arrow IPC streams, one for each batch, so that none holds more than a batch."""

    def run(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows", "payload"])

    return df.mapInArrow(run, "rows long, payload binary")


def from_ipc(streams: DataFrame, schema: Schema | T.StructType | str) -> DataFrame:
    """The rows of the Arrow IPC streams in the column payload."""

    def run(batches):
        for b in batches:
            for payload in b.column(0):
                yield from pa.ipc.open_stream(payload.as_buffer())

    return streams.select("payload").mapInArrow(run, _struct(schema))


def convert(spark: SparkSession, source: str, target: str, schema: Schema | T.StructType | str, file_format: str = "parquet", compression: str = "snappy", partitions: int | None = None, delimiter: str = "|", file_extension: str = ".tbl") -> None:
    """Delimited text to Parquet or CSV, dealt to a number of files in turn if one is given."""
    df = read_csv(spark, source, False, delimiter, file_extension, schema)
    df = df.repartition(partitions) if partitions else df
    if file_format == "parquet":
        write_parquet(df, target, compression)
    elif file_format == "csv":
        write_csv(df, target)
    else:
        raise ValueError(f"no output format is named {file_format!r}")
