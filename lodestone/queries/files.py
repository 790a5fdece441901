"""Text and Parquet files in and out: each query writes rows of a table into the shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import functions as L
from lodestone import sources
from lodestone.functions import col
from lodestone.queries.registry import Tables, frame_query
from lodestone.types import Field, Schema

SUPPLIER = Schema(Field("s_suppkey", "i64", True), Field("s_name", "utf8", True), Field("s_nationkey", "i32", True), Field("s_acctbal", "f64", True))
ALL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
#: Some names missing, so that nulls pass through the files too.
HOLES = "SELECT s_suppkey, nullif(s_name, 'Supplier#000000003') AS s_name, s_nationkey, s_acctbal FROM supplier"


def _supplier(t: Tables, holes: bool = False):
    df = t.supplier.select_columns("s_suppkey", "s_name", "s_nationkey", "s_acctbal").df
    return df.withColumn("s_name", L.nullif(col("s_name"), L.lit("Supplier#000000003"))) if holes else df


def _written(t: Tables, name: str, write, holes: bool = False) -> str:
    at = sources.scratch(t.context.spark, name)
    write(_supplier(t, holes), at)
    return at


@frame_query("scan_csv", HOLES)
def _(t):
    return t.context.read_csv(_written(t, "csv", sources.write_csv, True), schema=SUPPLIER)


@frame_query("scan_csv_inferred", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def _(t):
    read = t.context.read_csv(_written(t, "csv", sources.write_csv))
    return read.filter(col("s_acctbal") > 0).select(col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_nationkey", "s_acctbal")


@frame_query("scan_csv_delimiter", HOLES)
def _(t):
    at = _written(t, "csv", lambda df, at: sources.write_csv(df, at, False, ";"), True)
    return t.context.read_csv(at, has_header=False, delimiter=";", schema=SUPPLIER)


@frame_query("scan_csv_registered", "SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS high FROM supplier GROUP BY s_nationkey")
def _(t):
    t.context.register_csv("lodestone_supplier_csv", _written(t, "csv", sources.write_csv), schema=SUPPLIER)
    return t.context.sql("SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS high FROM lodestone_supplier_csv GROUP BY s_nationkey")


@frame_query("scan_external_csv", HOLES)
def _(t):
    at = _written(t, "csv", lambda df, at: sources.write_csv(df, at, True, "|"), True)
    t.context.create_external_table("lodestone_supplier_ext", at, "CSV", True, SUPPLIER, "|")
    return t.context.sql("SELECT * FROM lodestone_supplier_ext")


@frame_query("scan_external_ndjson", HOLES)
def _(t):
    t.context.create_external_table("lodestone_supplier_json", _written(t, "json", sources.write_json, True), "NDJSON", schema=SUPPLIER)
    return t.context.sql("SELECT * FROM lodestone_supplier_json")


@frame_query("scan_tbl", HOLES)
def _(t):
    return t.context.read_tbl(_written(t, "tbl", sources.write_tbl, True), SUPPLIER, ".txt")


@frame_query("scan_ndjson", HOLES)
def _(t):
    return t.context.read_json(_written(t, "json", sources.write_json, True), SUPPLIER)


@frame_query("sink_csv", "SELECT count(*) AS n, sum(CAST(s_acctbal AS DECIMAL(12, 2)))::DOUBLE AS total, count(nullif(s_name, 'Supplier#000000003')) AS names FROM supplier")
def _(t):
    read = t.context.read_csv(_written(t, "csv", sources.write_csv, True), schema=SUPPLIER)
    return read.aggregate([], [L.count("*").alias("n"), L.sum(col("s_acctbal").cast("decimal(12,2)")).cast("double").alias("total"), L.count("s_name").alias("names")])


for _codec in ("none", "snappy", "gzip", "lz4", "zstd"):

    @frame_query(f"sink_parquet_{_codec}", HOLES)
    def _(t, codec=_codec):
        return t.context.read_parquet(_written(t, "parquet", lambda df, at: sources.write_parquet(df, at, codec), True))


@frame_query("convert_tbl_to_parquet", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 3 AS files FROM supplier")
def _(t):
    at, to = _written(t, "tbl", sources.write_tbl), sources.scratch(t.context.spark, "converted")
    sources.convert(t.context.spark, at, to, SUPPLIER, "parquet", "zstd", 3, file_extension=".txt")
    return t.context.read_parquet(to).df.withColumn("files", F.lit(len(t.context.file_metadata(to).files)))


@frame_query("convert_tbl_to_csv", ALL)
def _(t):
    at, to = _written(t, "tbl", sources.write_tbl), sources.scratch(t.context.spark, "converted")
    sources.convert(t.context.spark, at, to, SUPPLIER, "csv", partitions=2, file_extension=".txt")
    return t.context.read_csv(to, schema=SUPPLIER)


@frame_query("sink_arrow_ipc", HOLES)
def _(t):
    at = _written(t, "ipc", lambda df, at: sources.write_parquet(sources.to_ipc(df), at), True)
    return sources.from_ipc(t.context.read_parquet(at).df, SUPPLIER)


@frame_query("file_metadata", "SELECT * FROM (VALUES ('n_nationkey', 'int', 1), ('n_name', 'string', 1), ('n_regionkey', 'int', 1)) AS t(name, type, files)")
def _(t):
    found = t.context.file_metadata(f"{t.sf_dir}/nation.parquet")
    return t.context.spark.createDataFrame([(f.name, f.dataType.simpleString(), len(found.files)) for f in found.schema], "name string, type string, files int")


@frame_query("stream_batches", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey < 5")
def _(t):
    some = t.customer.filter(col("c_nationkey") < 5).select_columns("c_custkey", "c_acctbal")
    return t.context.from_batches(list(some.stream(100)))  # a fifth of a small table


@frame_query("explain_plan", "SELECT * FROM (VALUES ('parsed'), ('logical'), ('physical')) AS t(plan_type)")
def _(t):
    return t.orders.filter(col("o_totalprice") > 1000).aggregate(["o_orderstatus"], [L.count("*").alias("n")]).explain(True).select_columns("plan_type")
