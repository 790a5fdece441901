"""Scans, filters, expressions, aggregates, joins, subqueries, sorts and partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import functions as L
from lodestone.functions import col, lit
from lodestone.operators import Partitioning
from lodestone.queries.registry import frame_query, sql_query

MONEY = "CAST({} AS DECIMAL(12, 2))"


def money(name: str):
    """Exact, so that sums are the same in any order."""
    return col(name).cast("decimal(12,2)")


def total(column, name: str):
    return L.sum(column).cast("double").alias(name)


# scans and projections


@frame_query("scan_parquet_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1998-01-01'")
def _(t):
    return t.lineitem.filter((col("l_quantity") > 45) & (col("l_shipdate") >= F.to_timestamp_ntz(lit("1998-01-01 00:00:00")))).select_columns("l_orderkey", "l_quantity")


@frame_query("scan_empty_one_row", "SELECT 1 AS one, 'x' AS letter")
def _(t):
    return t.context.empty(produce_one_row=True).select(lit(1).alias("one"), lit("x").alias("letter"))


@frame_query("scan_empty_relation", "SELECT r_regionkey, r_name FROM region WHERE 1 = 0")
def _(t):
    return t.context.empty("r_regionkey int, r_name string")


@frame_query("scan_batches", "SELECT n_name, n_nationkey FROM nation")
def _(t):
    return t.context.from_batches(t.nation.collect(), ["n_name", "n_nationkey"])  # a table of fixed size


@frame_query("scan_external_table", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def _(t):
    t.context.create_external_table("lodestone_part", f"{t.sf_dir}/part.parquet", "parquet")
    return t.context.sql("SELECT p_brand, count(*) AS n FROM lodestone_part GROUP BY p_brand")


@frame_query("scan_registered_table", "SELECT c_mktsegment, min(c_acctbal) AS low FROM customer GROUP BY c_mktsegment")
def _(t):
    t.context.register_parquet("lodestone_customer", f"{t.sf_dir}/customer.parquet")
    return t.context.sql("SELECT c_mktsegment, min(c_acctbal) AS low FROM lodestone_customer GROUP BY c_mktsegment")


@frame_query("project_columns", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return t.supplier.select_columns("s_suppkey", "s_name")


@frame_query("project_expressions", "SELECT s_suppkey + 1 AS next_key, upper(s_name) AS loud, 7 AS seven FROM supplier")
def _(t):
    return t.supplier.select((col("s_suppkey") + 1).alias("next_key"), L.upper(col("s_name")).alias("loud"), lit(7).alias("seven"))


sql_query("expr_wildcard", "SELECT * FROM {nation}")

# filters

FILTERS = {
    "eq": (lambda: col("o_orderstatus") == "F", "o_orderstatus = 'F'"),
    "ne": (lambda: col("o_orderstatus") != "F", "o_orderstatus <> 'F'"),
    "lt_le": (lambda: (col("o_totalprice") < 5000) | (col("o_custkey") <= 10), "o_totalprice < 5000 OR o_custkey <= 10"),
    "gt_ge": (lambda: (col("o_totalprice") > 100000) & (col("o_custkey") >= 100), "o_totalprice > 100000 AND o_custkey >= 100"),
    "not": (lambda: ~((col("o_orderstatus") == "F") | (col("o_orderstatus") == "O")), "NOT (o_orderstatus = 'F' OR o_orderstatus = 'O')"),
    "between": (lambda: L.between(col("o_custkey"), 20, 40), "o_custkey BETWEEN 20 AND 40"),
    "not_between": (lambda: L.between(col("o_custkey"), 20, 1000, negated=True), "o_custkey NOT BETWEEN 20 AND 1000"),
    "in_list": (lambda: col("o_orderpriority").isin("1-URGENT", "5-LOW"), "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "not_in_list": (lambda: ~col("o_orderpriority").isin("1-URGENT", "5-LOW"), "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    "like": (lambda: col("o_orderpriority").like("%-H%"), "o_orderpriority LIKE '%-H%'"),
    "not_like": (lambda: ~col("o_orderpriority").like("_-N%"), "o_orderpriority NOT LIKE '_-N%'"),
    "is_null": (lambda: L.nullif(col("o_orderstatus"), lit("P")).isNull(), "nullif(o_orderstatus, 'P') IS NULL"),
    "is_not_null": (lambda: L.nullif(col("o_orderstatus"), lit("P")).isNotNull(), "nullif(o_orderstatus, 'P') IS NOT NULL"),
    "modulus": (lambda: col("o_orderkey") % 7 == 3, "o_orderkey % 7 = 3"),
}
for _name, (_condition, _sql) in FILTERS.items():
    frame_query(f"filter_{_name}", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE {_sql}")(lambda t, c=_condition: t.orders.filter(c()).select_columns("o_orderkey", "o_custkey", "o_orderstatus"))

# expressions


@frame_query("expr_arithmetic", "SELECT p_partkey, p_size + 3 AS plus, p_size - 3 AS minus, p_size * 3 AS times, p_size / 4.0::DOUBLE AS ratio, -p_size AS negative, CAST(p_size % 5 AS INTEGER) AS rest FROM part")
def _(t):
    s = col("p_size")
    return t.part.select("p_partkey", (s + 3).alias("plus"), (s - 3).alias("minus"), (s * 3).alias("times"), (s / lit(4.0)).alias("ratio"), (-s).alias("negative"), (s % 5).alias("rest"))


@frame_query("expr_reflected", "SELECT p_partkey, 100 - p_size AS below, 2 * p_size AS twice FROM part")
def _(t):
    return t.part.select("p_partkey", (100 - col("p_size")).alias("below"), (2 * col("p_size")).alias("twice"))


@frame_query("expr_case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'some' END AS kind FROM customer")
def _(t):
    return t.customer.select("c_custkey", L.when(col("c_acctbal") < 0, "debt").when(col("c_acctbal") > 5000, "rich").otherwise("some").alias("kind"))


@frame_query("expr_case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS code FROM orders")
def _(t):
    return t.orders.select("o_orderkey", L.case(col("o_orderstatus")).when("F", "done").when("O", "open").build().alias("code"))


@frame_query("expr_cast", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_linenumber AS VARCHAR) AS text, CAST(l_shipdate AS DATE) AS day, CAST(l_linenumber AS DOUBLE) AS wide FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", L.trunc(col("l_extendedprice")).cast("long").alias("whole"), col("l_linenumber").cast("string").alias("text"), col("l_shipdate").cast("date").alias("day"), col("l_linenumber").cast("double").alias("wide"))


@frame_query("expr_boolean_three_valued", "SELECT o_orderkey, coalesce(CAST((nullif(o_orderstatus, 'F') = 'O') AND (o_custkey > 50) AS VARCHAR), 'unknown') AS both, coalesce(CAST((nullif(o_orderstatus, 'F') = 'O') OR (o_custkey > 50) AS VARCHAR), 'unknown') AS either FROM orders")
def _(t):
    a, b = L.nullif(col("o_orderstatus"), lit("F")) == "O", col("o_custkey") > 50
    text = lambda c: F.coalesce(c.cast("string"), lit("unknown"))
    return t.orders.select("o_orderkey", text(a & b).alias("both"), text(a | b).alias("either"))


sql_query("expr_date_interval", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH")
sql_query("expr_extract", "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, count(*) AS n FROM {orders} GROUP BY 1, 2")
sql_query("expr_substring", "SELECT c_custkey, substring(c_mktsegment FROM 1 FOR 2) AS code FROM {customer}")

# aggregates


@frame_query("agg_sum_avg_count", f"SELECT l_returnflag, CAST(sum({MONEY.format('l_extendedprice')}) AS DOUBLE) AS total, CAST(sum({MONEY.format('l_quantity')}) AS DOUBLE) / count(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.aggregate([col("l_returnflag")], [total(money("l_extendedprice"), "total"), (L.sum(money("l_quantity")).cast("double") / L.count("l_quantity")).alias("mean"), L.count("*").alias("n")])


@frame_query("agg_min_max", "SELECT l_linenumber, min(l_extendedprice) AS low, max(l_extendedprice) AS high, min(l_shipdate) AS first_day, max(l_returnflag) AS last_flag FROM lineitem GROUP BY l_linenumber")
def _(t):
    return t.lineitem.aggregate([col("l_linenumber")], [L.min("l_extendedprice").alias("low"), L.max("l_extendedprice").alias("high"), L.min("l_shipdate").alias("first_day"), L.max("l_returnflag").alias("last_flag")])


@frame_query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.aggregate([col("l_returnflag")], [L.count_distinct("l_suppkey").alias("suppliers"), L.count_distinct("l_partkey").alias("parts")])


@frame_query("agg_global", f"SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum({MONEY.format('o_totalprice')}) AS DOUBLE) AS total FROM orders")
def _(t):
    return t.orders.aggregate([], [L.count("*").alias("n"), L.min("o_totalprice").alias("low"), L.max("o_totalprice").alias("high"), total(money("o_totalprice"), "total")])


@frame_query("agg_avg", "SELECT p_brand, round(avg(p_size), 6) AS mean_size FROM part GROUP BY p_brand")
def _(t):
    return t.part.aggregate([col("p_brand")], [L.round(L.avg("p_size"), 6).alias("mean_size")])


@frame_query("agg_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50")
def _(t):
    return t.lineitem.aggregate([col("l_suppkey")], [L.count("*").alias("n")]).filter(col("n") > 50)


@frame_query("agg_case", "SELECT l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY l_linenumber")
def _(t):
    return t.lineitem.aggregate([col("l_linenumber")], [L.sum(L.when(col("l_returnflag") == "R", 1).otherwise(0)).alias("returned")])


@frame_query("agg_arithmetic", "SELECT l_returnflag, round(100.0::DOUBLE * count(CASE WHEN l_discount > 0.05 THEN 1 END) / count(*), 6) AS share FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.aggregate([col("l_returnflag")], [L.round(lit(100.0) * L.count(L.when(col("l_discount") > 0.05, 1).build()) / L.count("*"), 6).alias("share")])


@frame_query("agg_of_aggregate", "SELECT n_orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) AS x GROUP BY n_orders")
def _(t):
    return t.orders.aggregate([col("o_custkey")], [L.count("*").alias("n_orders")]).aggregate([col("n_orders")], [L.count("*").alias("customers")])


@frame_query("agg_by_expression", "SELECT l_orderkey % 10 AS slot, count(*) AS n FROM lineitem GROUP BY l_orderkey % 10")
def _(t):
    return t.lineitem.aggregate([(col("l_orderkey") % 10).alias("slot")], [L.count("*").alias("n")])


# joins


@frame_query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, ["o_custkey"], ["c_custkey"]).select_columns("o_orderkey", "c_name")


@frame_query("join_left", "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(t):
    return t.customer.join(t.orders, ["c_custkey"], ["o_custkey"], "left").select("c_custkey", F.coalesce("o_orderkey", lit(-1)).alias("o_orderkey"))


@frame_query("join_right", "SELECT coalesce(o_orderkey, -1) AS o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, ["o_custkey"], ["c_custkey"], "right").select(F.coalesce("o_orderkey", lit(-1)).alias("o_orderkey"), "c_custkey")


@frame_query("join_two_columns", "SELECT a.l_partkey, a.l_suppkey, a.n, b.m FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_partkey, l_suppkey, max(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def _(t):
    a = t.lineitem.aggregate(["l_partkey", "l_suppkey"], [L.count("*").alias("n")])
    b = t.lineitem.filter(col("l_returnflag") == "R").aggregate([col("l_partkey").alias("p"), col("l_suppkey").alias("s")], [L.max("l_quantity").alias("m")])
    return a.join(b, ["l_partkey", "l_suppkey"], ["p", "s"]).select_columns("l_partkey", "l_suppkey", "n", "m")


sql_query("join_comma", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
sql_query("join_residual", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey")
sql_query("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_disjunctive", "SELECT l_orderkey, p_brand FROM {lineitem}, {part} WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity < 10) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity > 40)")

# subqueries

sql_query("subq_exists", "SELECT o_orderkey FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
sql_query("subq_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql_query("subq_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_discount > 0.09)")


@frame_query("subq_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R')")
def _(t):
    return t.part.not_in("p_partkey", t.lineitem.filter(col("l_quantity") > 49, col("l_returnflag") == "R"), "l_partkey").select_columns("p_partkey")


@frame_query("subq_not_in_with_nulls", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT nullif(l_partkey, 7) FROM lineitem)")
def _(t):
    return t.part.not_in("p_partkey", t.lineitem.select(L.nullif(col("l_partkey"), lit(7)).alias("k")), "k").select_columns("p_partkey")


@frame_query("subq_not_in_nulls_left", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) AS c WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t):
    return t.customer.select("c_custkey", L.nullif(col("c_nationkey"), lit(3)).alias("k")).not_in("k", t.nation.filter(col("n_regionkey") == 1), "n_nationkey").select_columns("c_custkey")


@frame_query("subq_not_in_nothing", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) AS c WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 99)")
def _(t):
    return t.customer.select("c_custkey", L.nullif(col("c_nationkey"), lit(3)).alias("k")).not_in("k", t.nation.filter(col("n_regionkey") > 99), "n_nationkey").select_columns("c_custkey")


@frame_query("expr_variable", "SELECT p_partkey, 'a@low' AS mark FROM part WHERE p_size BETWEEN 3 AND 7 AND p_brand = 'Brand#3'")
def _(t):
    t.context.register_table("lodestone_part_vars", t.part)
    return t.context.sql("SELECT p_partkey, 'a@low' AS mark FROM lodestone_part_vars WHERE p_size BETWEEN @low AND @high AND p_brand = @brand", low=3, high=7, brand="Brand#3")


@frame_query("join_full", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 3) AS c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) AS o ON c_custkey = o_custkey")
def _(t):
    return t.customer.filter(col("c_nationkey") < 3).join(t.orders.filter(col("o_totalprice") > 400000), ["c_custkey"], ["o_custkey"], "full").select_columns("c_custkey", "o_orderkey")


sql_query("subq_scalar", "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT max(c_acctbal) * 0.9 FROM {customer})")
sql_query("subq_scalar_correlated", "SELECT l_orderkey, l_partkey, l_quantity FROM {lineitem} a WHERE l_quantity = (SELECT max(l_quantity) FROM {lineitem} b WHERE b.l_partkey = a.l_partkey)")
sql_query("subq_exists_unequal", "SELECT DISTINCT a.l_orderkey FROM {lineitem} a WHERE EXISTS (SELECT 1 FROM {lineitem} b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND a.l_returnflag = 'R'")

# sorts, limits, partitioning


@frame_query("sort_null_order", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status DESC NULLS LAST, o_orderkey ASC NULLS FIRST")
def _(t):
    return t.orders.select("o_orderkey", L.nullif(col("o_orderstatus"), lit("F")).alias("status")).sort(F.desc_nulls_last("status"), F.asc_nulls_first("o_orderkey"))


@frame_query("sort_limit_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.sort(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(25).select_columns("o_orderkey", "o_totalprice")


@frame_query("limit_rows", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS different, CAST(100 AS BIGINT) AS known FROM (SELECT * FROM orders LIMIT 100) AS x")
def _(t):
    some = t.orders.limit(100).df  # any hundred rows, all of the table
    return some.join(t.orders.df.select(col("o_orderkey").alias("k")), col("k") == col("o_orderkey"), "left").agg(L.count("*").alias("n"), L.count_distinct("o_orderkey").alias("different"), L.count("k").alias("known"))


@frame_query("part_hash", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t.lineitem.repartition(Partitioning.hash(16, "l_suppkey")).aggregate([col("l_suppkey")], [L.count("*").alias("n")])


@frame_query("part_unknown", "SELECT c_custkey, c_nationkey FROM customer")
def _(t):
    return t.customer.repartition(Partitioning.round_robin(6)).repartition(Partitioning.unknown(2)).select_columns("c_custkey", "c_nationkey")


@frame_query("part_round_robin", "SELECT c_custkey, c_name FROM customer")
def _(t):
    return t.customer.repartition(Partitioning.round_robin(6)).select_columns("c_custkey", "c_name")


@frame_query("part_merge", "SELECT s_suppkey FROM supplier")
def _(t):
    return t.supplier.select_columns("s_suppkey").merge()
