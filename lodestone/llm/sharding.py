"""Sharding by a permutation-filled lookup table, in DataFrame and SQL functions only.

Shard j prefers the slots of a table of prime size M in the order (offset_j + i * skip_j) mod M; as M is prime, that is
a permutation of all slots. The shards take turns, each claiming the first free slot of its order, until the table is
full, so that any two shards' slots differ by one in number at most, and few slots change hands when a shard comes or
goes. A claim costs the square root of M, the filling of the table M times that. The table has M rows, whatever the
data: it is broadcast, and a row's place is one look-up by the hash of its key.

Defined results: a null key is hashed as ''; rows with equal keys get the same shard; an empty table gives an empty
result; ``place`` keeps further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free_names, table

SLOTS, SHARDS = 2039, 16


def _number(text: str) -> str:
    return f"cast(conv(substring(md5({text}), 1, 8), 16, 10) AS long)"


def lookup(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(_slot, _shard), a row a slot. slots must be a prime above shards."""
    if shards < 1 or slots <= shards or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots for {shards} shards: a prime above the number of shards is needed")
    names = f"transform(sequence(0, {shards - 1}), j -> concat('shard-', j))"
    one = spark.range(1).selectExpr(f"transform({names}, s -> {_number('concat(s, chr(58), chr(111))')} % {slots}) AS off", f"transform({names}, s -> 1 + {_number('concat(s, chr(58), chr(115))')} % {slots - 1}) AS skip")
    # the table and the shards' places in their orders are arrays of arrays, so that a claim rewrites a row of each alone
    wide, long = int(slots**0.5) + 1, int(shards**0.5) + 1
    free = f"i -> s.tab[cast((off[t % {shards}] + i * skip[t % {shards}]) % {slots} AS int) div {wide}][cast((off[t % {shards}] + i * skip[t % {shards}]) % {slots} AS int) % {wide}] < 0"
    begin = f"s.nxt[(t % {shards}) div {long}][(t % {shards}) % {long}]"
    # most claims succeed within a few steps; the whole rest of the order is looked at only where they don't
    step = f"coalesce(get(filter(sequence({begin}, least({begin} + 31, {slots - 1})), {free}), 0), get(filter(sequence({begin}, {slots - 1}), {free}), 0))"
    put = lambda rows, at, size, value: f"transform({rows}, (r, k) -> if(k = {at} div {size}, transform(r, (x, q) -> if(q = {at} % {size}, {value}, x)), r))"
    claimed = f"cast((off[t % {shards}] + i * skip[t % {shards}]) % {slots} AS int)"
    claim = f"transform(array({step}), i -> transform(array({claimed}), c -> struct({put('s.tab', 'c', wide, f't % {shards}')} AS tab, {put('s.nxt', f'(t % {shards})', long, 'i + 1')} AS nxt))[0])[0]"
    empty = f"struct(array_repeat(array_repeat(-1, {wide}), {wide}) AS tab, array_repeat(array_repeat(0L, {long}), {long}) AS nxt)"
    fold = f"flatten(aggregate(sequence(0, {slots - 1}), {empty}, (s, t) -> {claim}).tab)"
    return one.selectExpr(f"posexplode(slice({fold}, 1, {slots})) AS (_slot, _shard)").selectExpr("cast(_slot AS long) AS _slot", "cast(_shard AS long) AS _shard")


def place(rows: DataFrame, key_col: str, shards: int = SHARDS, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """rows with the slot and the shard of each key; names that rows has already get underscores."""
    slot_name, shard_name = free_names(rows, slot_name, shard_name)
    n = F.conv(F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    keyed = rows.select(F.struct("*").alias("row"), (n % slots).alias("_slot_of"))
    return keyed.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), F.col("_slot_of") == F.col("_slot")).select("row.*", F.col("_slot").alias(slot_name), F.col("_shard").alias(shard_name))


def write(rows: DataFrame, key_col: str, path: str, shards: int = SHARDS, slots: int = SLOTS) -> None:
    """Parquet under path, a folder a shard."""
    slot_name, shard_name = free_names(rows, "slot", "shard")
    place(rows, key_col, shards, slots).drop(slot_name).write.partitionBy(shard_name).parquet(path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


ORACLE = f"""
WITH RECURSIVE pref AS (
  SELECT j, CAST(CAST('0x' || substr(md5('shard-' || j || ':o'), 1, 8) AS UBIGINT) % {SLOTS} AS BIGINT) AS off,
    CAST(1 + CAST('0x' || substr(md5('shard-' || j || ':s'), 1, 8) AS UBIGINT) % {SLOTS - 1} AS BIGINT) AS skip
  FROM range({SHARDS}) AS t(j)
), arr AS (
  SELECT list(off ORDER BY j) AS off, list(skip ORDER BY j) AS skip FROM pref
), fill AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(range({SLOTS}), lambda x: CAST(-1 AS BIGINT)) AS tab
  UNION ALL
  SELECT t + 1, list_transform(tab, lambda v, q: CASE WHEN q - 1 = c THEN t % {SHARDS} ELSE v END)
  FROM (
    SELECT fill.t, fill.tab, (arr.off[fill.t % {SHARDS} + 1] + list_filter(range({SLOTS}), lambda i: fill.tab[(arr.off[fill.t % {SHARDS} + 1] + i * arr.skip[fill.t % {SHARDS} + 1]) % {SLOTS} + 1] < 0)[1] * arr.skip[fill.t % {SHARDS} + 1]) % {SLOTS} AS c
    FROM fill, arr WHERE fill.t < {SLOTS}
  )
), slots AS (
  SELECT unnest(range({SLOTS})) AS slot, unnest(tab) AS shard FROM fill WHERE t = {SLOTS}
)
SELECT doc_id, CAST(slot AS BIGINT) AS slot, CAST(shard AS BIGINT) AS shard
FROM documents JOIN slots ON slot = CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) % {SLOTS} AS BIGINT)
"""
