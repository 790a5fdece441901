"""One query for each scalar function, over columns of the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lodestone import functions as L
from lodestone.functions import col, lit
from lodestone.queries.registry import frame_query

UNIT = (lambda: (col("c_acctbal") + 1000) / 20000, "((c_acctbal + 1000) / 20000)")  # within 0 and 1
ACCT = (lambda: col("c_acctbal"), "c_acctbal")

# function -> (column of Spark, SQL); results of transcendental functions are compared to nine digits
NUMBERS = {
    "sqrt": (L.sqrt, "sqrt", UNIT), "sin": (L.sin, "sin", UNIT), "cos": (L.cos, "cos", UNIT), "tan": (L.tan, "tan", UNIT), "asin": (L.asin, "asin", UNIT), "acos": (L.acos, "acos", UNIT), "atan": (L.atan, "atan", ACCT),
    "exp": (L.exp, "exp", UNIT), "ln": (L.ln, "ln", (lambda: L.abs(col("c_acctbal")) + 1, "(abs(c_acctbal) + 1)")), "log2": (L.log2, "log2", (lambda: L.abs(col("c_acctbal")) + 1, "(abs(c_acctbal) + 1)")),
    "log10": (L.log10, "log10", (lambda: L.abs(col("c_acctbal")) + 1, "(abs(c_acctbal) + 1)")),
}
for _name, (_fn, _sql, (_arg, _text)) in NUMBERS.items():
    frame_query(f"fn_{_name}", f"SELECT c_custkey, round({_sql}({_text}), 9) AS value FROM customer")(lambda t, f=_fn, a=_arg: t.customer.select("c_custkey", L.round(f(a()), 9).alias("value")))

EXACT = {
    "floor": (lambda: L.floor(col("c_acctbal")), "CAST(floor(c_acctbal) AS DOUBLE)"),
    "ceil": (lambda: L.ceil(col("c_acctbal")), "CAST(ceil(c_acctbal) AS DOUBLE)"),
    "round": (lambda: L.round(col("c_acctbal")), "round(c_acctbal)"),
    "trunc": (lambda: L.trunc(col("c_acctbal")), "trunc(c_acctbal)"),
    "abs": (lambda: L.abs(col("c_acctbal")), "abs(c_acctbal)"),
    "signum": (lambda: L.signum(col("c_acctbal")), "CAST(sign(c_acctbal) AS DOUBLE)"),
    "octet_length": (lambda: L.octet_length(col("c_name")), "CAST(strlen(c_name) AS INTEGER)"),
    "concat": (lambda: L.concat(col("c_name"), lit("/"), L.nullif(col("c_mktsegment"), lit("BUILDING"))), "c_name || '/' || nullif(c_mktsegment, 'BUILDING')"),
    "lower": (lambda: L.lower(col("c_mktsegment")), "lower(c_mktsegment)"),
    "upper": (lambda: L.upper(col("c_name")), "upper(c_name)"),
    "trim": (lambda: L.trim(L.concat(lit("  "), col("c_name"), lit(" "))), "trim('  ' || c_name || ' ')"),
    "ltrim": (lambda: L.ltrim(L.concat(lit("  "), col("c_name"), lit(" "))), "ltrim('  ' || c_name || ' ')"),
    "rtrim": (lambda: L.rtrim(L.concat(lit("  "), col("c_name"), lit(" "))), "rtrim('  ' || c_name || ' ')"),
    "nullif": (lambda: L.nullif(col("c_mktsegment"), lit("MACHINERY")), "nullif(c_mktsegment, 'MACHINERY')"),
    "array": (lambda: F.to_json(L.array(col("c_nationkey"), col("c_nationkey") + 1)), "'[' || c_nationkey || ',' || (c_nationkey + 1) || ']'"),
    "md5": (lambda: L.md5(col("c_name")), "md5(c_name)"),
    "sha256": (lambda: L.sha256(col("c_name")), "sha256(c_name)"),
}
for _name, (_column, _sql) in EXACT.items():
    frame_query(f"fn_{_name}", f"SELECT c_custkey, {_sql} AS value FROM customer" if _sql else None)(lambda t, c=_column: t.customer.select("c_custkey", c().alias("value")))


@frame_query("fn_to_timestamp", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 12:30:00' AS TIMESTAMP) AS value FROM orders")
def _(t):
    return t.orders.select("o_orderkey", L.to_timestamp(L.concat(col("o_orderdate").cast("date").cast("string"), lit(" 12:30:00"))).alias("value"))


@frame_query("fn_date_trunc", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS value FROM orders")
def _(t):
    return t.orders.select("o_orderkey", L.date_trunc("month", col("o_orderdate")).alias("value"))


#: The names of the region table; the SQL side has no such digests and compares with those of an independent library.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
for _name in ("sha224", "sha384", "sha512"):
    _cases = " ".join(f"WHEN '{r}' THEN '{hashlib.new(_name, r.encode()).hexdigest()}'" for r in REGIONS)
    frame_query(f"fn_{_name}", f"SELECT r_name, CASE r_name {_cases} END AS value FROM region")(lambda t, f=getattr(L, _name): t.region.select("r_name", f(col("r_name")).alias("value")))

#: What the functions give at the edges of their domains, as text, in the order of EDGES.
EDGES = ("NaN", "Infinity", "-Infinity", "1.0E20", "-1.0E20", "0.0", "-1.0", "2.5", "4503599627370497.0")
AT_EDGES = {
    "floor": ("NaN", "Infinity", "-Infinity", "1.0E20", "-1.0E20", "0.0", "-1.0", "2.0", "4.503599627370497E15"),
    "ceil": ("NaN", "Infinity", "-Infinity", "1.0E20", "-1.0E20", "0.0", "-1.0", "3.0", "4.503599627370497E15"),
    "trunc": ("NaN", "Infinity", "-Infinity", "1.0E20", "-1.0E20", "0.0", "-1.0", "2.0", "4.503599627370497E15"),
    "ln": ("NaN", "Infinity", "NaN", "46.0517", "NaN", "-Infinity", "NaN", "0.9163", "36.0437"),
    "log2": ("NaN", "Infinity", "NaN", "66.4386", "NaN", "-Infinity", "NaN", "1.3219", "52.0"),
    "log10": ("NaN", "Infinity", "NaN", "20.0", "NaN", "-Infinity", "NaN", "0.3979", "15.6536"),
}
for _name, _want in AT_EDGES.items():
    _values = ", ".join(f"('{x}', '{y}')" for x, y in zip(EDGES, _want, strict=True))
    _round = (lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.round(c, 4))) if _name.startswith("l") else (lambda c: c)
    frame_query(f"edges_{_name}", f"SELECT x, value FROM (VALUES {_values}, (NULL, NULL)) AS t(x, value)")(
        lambda t, f=getattr(L, _name), r=_round: t.context.empty(produce_one_row=True).select(F.explode(F.array(*map(lit, EDGES), lit(None).cast("string"))).alias("x")).select("x", r(f(col("x").cast("double"))).cast("string").alias("value"))
    )
