"""The public surface: context, frame, functions, types, sources, plans, streams."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import functions as L
from lodestone import sources, streaming
from lodestone import types as E
from lodestone.context import EngineContext
from lodestone.functions import col, lit
from lodestone.operators import Partitioning
from lodestone.plans import diagram, explained, nodes, tree


@pytest.fixture(scope="module")
def context(spark):
    return EngineContext(spark, batch__size=5000)


def test_settings(context, spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "5000"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_csv_and_tbl(context, spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x\n1,one,1.5\n2,,2.5\n")
    (tmp_path / "b.tbl").write_text("1|one|1.5|\n2|two|2.5|\n")
    a = context.read_csv(str(tmp_path))
    assert [f.datatype().spark.simpleString() for f in a.schema().fields] == ["int", "string", "double"]
    assert [tuple(r) for r in a.df.orderBy("id").collect()] == [(1, "one", 1.5), (2, None, 2.5)]
    schema = E.Schema(E.Field("id", "i64"), E.Field("name", "utf8"), E.Field("x", "f64"))
    assert [tuple(r) for r in context.read_tbl(str(tmp_path), schema).df.orderBy("id").collect()] == [(1, "one", 1.5), (2, "two", 2.5)]
    context.register_csv("from_csv", str(tmp_path))
    assert context.sql("SELECT sum(x) AS s FROM from_csv").collect()[0].to_pylist() == [{"s": 4.0}]
    with pytest.raises(ValueError):
        context.register_csv("", str(tmp_path))
    with pytest.raises(ValueError):
        context.register_parquet("", str(tmp_path))
    with pytest.raises(ValueError):
        context.read_csv(str(tmp_path), delimiter="é")
    sources.convert(spark, str(tmp_path), str(tmp_path / "out"), schema, partitions=2)
    assert len(context.file_metadata(str(tmp_path / "out")).files) == 2
    assert context.file_metadata(str(tmp_path / "out")).schema.names == ["id", "name", "x"]
    with pytest.raises(NotImplementedError):
        context.file_metadata(str(tmp_path), "csv")
    sources.convert(spark, str(tmp_path), str(tmp_path / "csv"), schema, "csv")
    assert context.read_csv(str(tmp_path / "csv")).df.count() == 2
    with pytest.raises(ValueError):
        sources.write_parquet(a.df, str(tmp_path / "no"), "rar")
    context.create_external_table("ext", str(tmp_path / "a.csv"), "CSV", True, schema)
    assert context.table("ext").df.count() == 2
    (tmp_path / "j.json").write_text('{"id": 1}\n{"id": null}\n')
    assert context.read_json(str(tmp_path / "j.json"), "id long").df.count() == 2


def test_codecs_are_checked_before_the_write(spark, tmp_path):
    for codec in ("brotli", "lzo"):
        with pytest.raises(ValueError, match=codec):
            sources.write_parquet(spark.range(1), str(tmp_path / codec), codec)
        assert not (tmp_path / codec).exists()


def test_stream_schema_and_sizes(context, spark, sf):
    frame = context.read_parquet(f"{sf}/customer.parquet")
    batches = list(frame.stream(40))
    assert [b.num_rows for b in batches] == [40, 40, 40, 30] and batches[0].schema.names == frame.df.columns
    assert [(f.qualifier, f.name) for f in frame.schema("c").fields][0] == ("c", "c_custkey")
    arrays = spark.sql("SELECT explode(array(array(1, 2), null)) AS a")
    assert [r[0] for r in arrays.select(E.check_size(col("a"), 2)).collect()] == [[1, 2], None]
    with pytest.raises(Exception, match="an array of 2 values where 3 are due"):
        arrays.select(E.check_size(col("a"), 3)).collect()


def test_empty_and_batches(context):
    assert context.empty("a int").collect() == [] or context.empty("a int").df.count() == 0
    assert context.empty(produce_one_row=True).select(lit(3).alias("x")).df.collect()[0]["x"] == 3
    got = context.from_batches(pa.table({"a": [1, 2], "b": ["x", None]}), ["b"])
    assert [r["b"] for r in got.df.collect()] == ["x", None]


def test_frame(context, sf):
    nation, region = context.read_parquet(f"{sf}/nation.parquet"), context.read_parquet(f"{sf}/region.parquet")
    joined = nation.join(region, ["n_regionkey"], ["r_regionkey"])
    out = joined.filter(col("r_name") == "ASIA", col("n_nationkey") > 0).aggregate([col("r_name")], [L.count("*").alias("n")]).sort(F.asc("r_name")).limit(5)
    assert out.collect()[0].schema.names == ["r_name", "n"]
    assert nation.repartition(Partitioning.hash(3, "n_regionkey")).df.rdd.getNumPartitions() == 3
    assert nation.repartition(Partitioning.round_robin(4)).repartition(Partitioning.unknown(2)).df.rdd.getNumPartitions() == 2
    assert nation.repartition(Partitioning.round_robin(4)).merge().df.rdd.getNumPartitions() == 1
    assert [r["plan_type"] for r in out.explain(True).df.collect()] == ["parsed", "logical", "physical"]
    assert "Join" in out.to_logical_plan()
    for bad in (([], []), (["n_regionkey"], [])):
        with pytest.raises(ValueError):
            nation.join(region, *bad)
    with pytest.raises(ValueError):
        nation.join(region, ["n_regionkey"], ["r_regionkey"], "sideways")
    with pytest.raises(ValueError):
        Partitioning.hash(3)


def test_case_builder(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).collect()[0]["x"]
    assert get(L.when(lit(False), 1).build()) is None
    assert get(L.case(lit(3)).when(2, "two").when(3, "three").otherwise("many")) == "three"
    with pytest.raises(ValueError):
        L.CaseBuilder().build()
    with pytest.raises(ValueError):
        L.CaseBuilder().otherwise(1)
    b = L.when(lit(True), 1)
    b.build()
    with pytest.raises(ValueError):
        b.when(lit(True), 2)


@pytest.mark.parametrize("name,value,want", [("trunc", -1.7, -1.0), ("trunc", 1.7, 1.0), ("floor", -1.5, -2.0), ("ceil", -1.5, -1.0), ("round", 2.5, 3.0), ("signum", -3.0, -1.0), ("ln", 0.0, float("-inf")), ("floor", 1e20, 1e20), ("log2", 8.0, 3.0), ("sha224", "abc", "23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7"), ("octet_length", "é", 2), ("md5", "", "d41d8cd98f00b204e9800998ecf8427e")])
def test_functions(spark, name, value, want):
    assert spark.range(1).select(getattr(L, name)(lit(value)).alias("x")).collect()[0]["x"] == want


def test_nulls_pass_through_functions(spark):
    row = spark.range(1).select(*[getattr(L, n)(lit(None).cast("double")).alias(n) for n in ("sqrt", "floor", "trunc", "abs", "log2")], L.concat(lit("a"), lit(None).cast("string")).alias("c")).collect()[0]
    assert set(row) == {None}


def test_types():
    for name in E.NAMES:
        t = E.DataType(name)
        assert E.DataType.from_json(t.to_json()) == t
    assert E.DataType("u64").spark == T.DecimalType(20, 0) and E.DataType("u8").is_numeric() and not E.DataType("utf8").is_numeric()
    f = E.Field("a", "i32", qualifier="t")
    assert not f.is_nullable() and E.Field.from_json(f.to_json()) == f
    s = E.Schema(f, E.Field("b", E.List(E.Field("item", "f32", True)), True), origin="here")
    assert E.Schema.from_json(s.to_json()) == s
    both = E.DFSchema(f).join(E.DFSchema(qualifier="u", schema=s))
    assert [(x.qualifier, x.name) for x in both.fields] == [("t", "a"), ("u", "a"), ("u", "b")]
    with pytest.raises(ValueError):
        E.DFSchema(f).join(E.DFSchema(f))
    assert E.Date() == E.DataType("date64") and E.Date(True) == E.DataType("date32")
    assert E.Timestamp("Nanosecond", "UTC").spark == T.TimestampType() and E.Timestamp().spark == T.TimestampNTZType()
    assert E.Struct(f).spark.names == ["a"] and E.Dictionary(E.DataType("i8"), E.DataType("utf8")) == E.DataType("utf8")
    for bad in (lambda: E.DataType("day32"), lambda: E.FixedSizeBinary(-1), lambda: E.FixedSizeList(f, -2), E.Struct, E.Union, lambda: E.Interval("Weeks"), lambda: E.Time("Nanosecond", True), lambda: E.Duration("Days")):
        with pytest.raises(ValueError):
            bad()


def test_plans(context, sf):
    df = context.read_parquet(f"{sf}/lineitem.parquet").filter(col("l_quantity") > 45).aggregate([col("l_returnflag")], [L.count("*").alias("n")]).sort(F.asc("l_returnflag")).df
    physical = explained(df)["physical"]
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in physical and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in physical
    found = nodes(tree(df))
    assert {n.stage for n in found} == {0, 1, 2} and sum("HashAggregate" in n.name for n in found) == 2
    assert diagram(df).count("subgraph") == 3
    top = context.read_parquet(f"{sf}/orders.parquet").sort(F.desc("o_totalprice")).limit(3).df
    assert "TakeOrderedAndProject" in explained(top)["physical"]


def test_subqueries_become_joins(context, spark, sf):
    from lodestone.queries import QUERIES

    plan = lambda n: explained(QUERIES[n](spark, sf))["logical"]
    assert "Join LeftSemi" in plan("subq_exists") and "Join LeftAnti" in plan("subq_not_exists") and "Join LeftAnti" in plan("subq_not_in") and "OR isnull" not in plan("subq_not_in") and "Join" in plan("subq_scalar_correlated")


def test_jobs(context):
    job = context.submit("SELECT count(*) AS n FROM range(1000)")
    assert job.result(120).to_pylist() == [{"n": 1000}] and job.status == "completed"
    bad = context.submit("SELECT raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        bad.result(120)
    assert bad.status == "failed"


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/events.parquet").symlink_to(f"{sf}/events.parquet")
    count = [F.count("*").alias("n")]
    want = {tuple(r) for r in streaming.windowed(events, "ts", "1 hour", ["event_type"], count).collect()}
    stream = streaming.windowed(streaming.read_stream(spark, str(tmp_path / "in"), events.schema), "ts", "1 hour", ["event_type"], count)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("windows").collect()} == want and want
