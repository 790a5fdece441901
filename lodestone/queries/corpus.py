"""The decision-support corpus, fitted to the columns of the driver's tables; both engines run one text."""

from __future__ import annotations

import re

from lodestone.queries.registry import sql_query

PRICE, DISCOUNT, TAX, QUANTITY = "CAST(l_extendedprice AS DECIMAL(12, 2))", "CAST(l_discount AS DECIMAL(4, 2))", "CAST(l_tax AS DECIMAL(4, 2))", "CAST(l_quantity AS DECIMAL(12, 2))"
NET = f"{PRICE} * (1 - {DISCOUNT})"


def ps(where: str) -> str:
    """Part by supplier, out of the line items that a query needs: what it asks of parts or suppliers comes before the sums."""
    return f"(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice) AS ps_supplycost, CAST(sum(l_quantity) AS BIGINT) AS ps_availqty FROM {{lineitem}} WHERE {where} GROUP BY l_partkey, l_suppkey)"


PARTS_02 = "l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size <= 15 AND p_type LIKE '%ARD')"
PARTS_09 = "l_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE '%widget%')"
PARTS_20 = "l_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE 'small%')"
SUPPLIERS_11 = "l_suppkey IN (SELECT s_suppkey FROM {supplier}, {nation} WHERE s_nationkey = n_nationkey AND n_name = 'NATION_7')"
COST = "CAST(ps_supplycost AS DECIMAL(12, 2))"


def dsum(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE)"


CORPUS = {
    "q01": f"""SELECT l_returnflag, l_linestatus, {dsum(QUANTITY)} AS sum_qty, {dsum(PRICE)} AS sum_base_price, {dsum(NET)} AS sum_disc_price, {dsum(f"{NET} * (1 + {TAX})")} AS sum_charge,
        {dsum(QUANTITY)} / count(*) AS avg_qty, {dsum(PRICE)} / count(*) AS avg_price, {dsum(DISCOUNT)} / count(*) AS avg_disc, count(*) AS count_order
        FROM {{lineitem}} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q02": f"""SELECT s_acctbal, s_name, n_name, p_partkey FROM {{part}}, {{supplier}}, {ps(PARTS_02)} ps, {{nation}}, {{region}}
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size <= 15 AND p_type LIKE '%ARD' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
        AND ps_supplycost = (SELECT min(ps2.ps_supplycost) FROM {ps(PARTS_02)} ps2, {{supplier}} s2, {{nation}} n2, {{region}} r2 WHERE p_partkey = ps2.ps_partkey AND s2.s_suppkey = ps2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC NULLS LAST, n_name NULLS FIRST, s_name NULLS FIRST, p_partkey NULLS FIRST""",
    "q03": f"""SELECT l_orderkey, {dsum(NET)} AS revenue, o_orderdate FROM {{customer}}, {{orders}}, {{lineitem}} WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC NULLS LAST, o_orderdate NULLS FIRST""",
    "q04": """SELECT o_orderpriority, count(*) AS order_count FROM {orders} WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH
        AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q05": f"""SELECT n_name, {dsum(NET)} AS revenue FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
        AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name ORDER BY revenue DESC NULLS LAST""",
    "q06": f"""SELECT {dsum(f"{PRICE} * {DISCOUNT}")} AS revenue FROM {{lineitem}} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR AND {DISCOUNT} BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 AND l_discount BETWEEN 0.04 AND 0.08 AND l_quantity < 24""",
    "q07": f"""SELECT supp_nation, cust_nation, l_year, {dsum("volume")} AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, {NET} AS volume
        FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "q08": f"""SELECT o_year, round({dsum("CASE WHEN nation = 'NATION_6' THEN volume ELSE 0 END")} / {dsum("volume")}, 6) AS mkt_share FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, {NET} AS volume, n2.n_name AS nation
        FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}} WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
        AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year ORDER BY o_year""",
    "q09": f"""SELECT nation, o_year, {dsum("amount")} AS sum_profit FROM (SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS INT) AS o_year, {NET} - {COST} * {QUANTITY} AS amount
        FROM {{part}}, {{supplier}}, {{lineitem}}, {ps(PARTS_09)} ps, {{orders}}, {{nation}} WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey
        AND p_name LIKE '%widget%') AS profit GROUP BY nation, o_year ORDER BY nation, o_year DESC NULLS LAST""",
    "q10": f"""SELECT c_custkey, c_name, {dsum(NET)} AS revenue, c_acctbal, n_name FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01'
        AND o_orderdate < DATE '1997-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC NULLS LAST""",
    "q11": f"""SELECT ps_partkey, {dsum(f"{COST} * ps_availqty")} AS value FROM {ps(SUPPLIERS_11)} ps, {{supplier}}, {{nation}} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey
        HAVING {dsum(f"{COST} * ps_availqty")} > (SELECT {dsum(f"{COST} * ps_availqty")} * 0.001 FROM {ps(SUPPLIERS_11)} ps2, {{supplier}}, {{nation}} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7') ORDER BY value DESC NULLS LAST""",
    "q12": """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-01-01' + INTERVAL '1' YEAR GROUP BY l_linestatus ORDER BY l_linestatus""",
    "q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
        GROUP BY c_count ORDER BY custdist DESC NULLS LAST, c_count DESC NULLS LAST""",
    "q14": f"""SELECT round(100.00 * {dsum(f"CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END")} / {dsum(NET)}, 6) AS promo_revenue FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-09-01' + INTERVAL '1' MONTH""",
    "q16": """SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM {lineitem}) ps, {part} WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%'
        AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC NULLS LAST, p_brand, p_type, p_size""",
    "q17": f"""SELECT round({dsum(PRICE)} / 7.0, 6) AS avg_yearly FROM {{lineitem}}, {{part}} WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(l2.l_quantity) FROM {{lineitem}} l2 WHERE l2.l_partkey = p_partkey)""",
    "q18": f"""SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {dsum(QUANTITY)} AS sum_qty FROM {{customer}}, {{orders}}, {{lineitem}} WHERE o_orderkey IN (SELECT l_orderkey FROM {{lineitem}} GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
        AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC NULLS LAST, o_orderdate NULLS FIRST""",
    "q19": f"""SELECT {dsum(NET)} AS revenue FROM {{lineitem}}, {{part}} WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15)
        OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 30) OR (p_partkey = l_partkey AND p_brand = 'Brand#24' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 45)""",
    "q20": f"""SELECT s_name, s_suppkey FROM {{supplier}}, {{nation}} WHERE s_suppkey IN (SELECT ps_suppkey FROM {ps(PARTS_20)} ps WHERE ps_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_name LIKE 'small%')
        AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM {{lineitem}} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-01-01' + INTERVAL '1' YEAR)) AND s_nationkey = n_nationkey AND n_name <> 'NATION_3' ORDER BY s_name""",
    "q21": """SELECT s_name, count(*) AS numwait FROM {supplier}, {lineitem} l1, {orders}, {nation} WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '30' DAY
        AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate) AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY s_name ORDER BY numwait DESC NULLS LAST, s_name""",
    "q22": """SELECT cntrycode, count(*) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(12, 2))) AS DOUBLE) AS totacctbal FROM (SELECT substring(c_mktsegment FROM 1 FOR 2) AS cntrycode, c_acctbal FROM {customer} WHERE substring(c_mktsegment FROM 1 FOR 2) IN ('AU', 'BU', 'FU', 'HO', 'MA')
        AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) AS custsale GROUP BY cntrycode ORDER BY cntrycode""",
}
#: NOT IN as Spark should run it: a join by key and counts of what nulls decide, not a broadcast of the whole subquery.
NOT_IN = "ps_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0)"
BY_KEY = """NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_acctbal < 0 AND s_suppkey = ps_suppkey) AND (SELECT count(*) FROM {supplier} WHERE s_acctbal < 0 AND s_suppkey IS NULL) = 0
        AND (ps_suppkey IS NOT NULL OR (SELECT count(*) FROM {supplier} WHERE s_acctbal < 0) = 0)"""
for _name, _text in CORPUS.items():
    sql_query(f"tpch_{_name}", _text.replace(NOT_IN, BY_KEY), re.sub(r"\{(\w+)\}", r"\1", _text))
