"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

A source's rows are cut into blocks of BLOCK rows. Source s has a_s of the L units of a period. Its k-th block of a
period is released at floor(k L / a_s) and due at ceil((k + 1) L / a_s); in every slot the released block with the
earliest deadline runs (ties: the earlier source in order of its name). As the units sum to L, all deadlines hold, so
that after any number of slots each source is less than one block away from its share, and the schedule repeats with
the period. It is folded once, in SQL, over L slots and S sources: its size depends on the number of sources alone.
Once a source is used up its slots stay empty, and the others go on in the same proportions; no row is left out.

Rows are numbered within a source in order of md5(id), then id, then a hash of the text: a seeded shuffle whose leading
hex digits cut even the largest source into PREFIX ** 16 groups; a group's first number is the sum of the groups before it.

Defined results: a null source is a source of its own, first in order; a null id is hashed as ''; rows with equal ids
follow each other; an empty table gives an empty result; further columns, whatever their names, are kept by ``mix`` and ignored by ``schedule``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table

BLOCK, PERIOD, PREFIX = 16, 1024, 3
#: Sources up to which the schedule (PERIOD slots for every PERIOD / 4 sources) is sent to every task; with more it is joined by a shuffle.
SENT = 4096


def units(counts: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """One row: names (sorted), a (their units) and L (the period). counts: (_key, n). Without weights a source weighs floor(sqrt(rows)); a source that weights doesn't name weighs 1."""
    w = F.floor(F.sqrt(F.col("n"))).cast("long")
    if weights is not None:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit("=" + k), F.lit(int(v)).cast("long"))]) if weights else None
        w = F.coalesce(given[F.col("_key")], F.lit(1)) if weights else F.lit(1).cast("long")
    one = counts.select("_key", F.greatest(w, F.lit(1).cast("long")).alias("w")).agg(F.array_sort(F.collect_list(F.struct("_key", "w"))).alias("s"))
    one = one.where("size(s) > 0").selectExpr("s", f"{PERIOD} * ((size(s) + {PERIOD // 4 - 1}) div {PERIOD // 4}) AS L", "aggregate(s, 0L, (x, y) -> x + y.w) AS total")
    # one unit each, the rest in proportion; what rounding leaves goes to the largest remainders
    one = one.selectExpr("*", "transform(s, y -> 1 + ((L - size(s)) * y.w) div total) AS low", "transform(s, (y, i) -> struct(-(((L - size(s)) * y.w) % total) AS r, i AS i)) AS rest")
    one = one.selectExpr("*", "transform(slice(array_sort(rest), 1, cast(L - aggregate(low, 0L, (x, y) -> x + y) AS int)), y -> y.i) AS more")
    return one.selectExpr("transform(s, y -> y._key) AS names", "transform(low, (y, i) -> y + if(array_contains(more, i), 1, 0)) AS a", "L")


def pattern(one: DataFrame) -> DataFrame:
    """The schedule of one period: (_key, a, L, k, slot), a row a slot."""
    due = "array_min(transform(filter(sequence(0, size(a) - 1), i -> (s.k[i] * L) div a[i] <= t), i -> struct(((s.k[i] + 1) * L + a[i] - 1) div a[i] AS d, i AS i)))"
    step = f"transform(array({due}), p -> struct(transform(s.k, (v, j) -> v + if(j = p.i, 1L, 0L)) AS k, array_append(s.ran, struct(p.i AS i, s.k[p.i] AS k)) AS ran))[0]"
    fold = f"aggregate(sequence(0L, L - 1), struct(transform(a, x -> 0L) AS k, cast(array() AS array<struct<i:int,k:bigint>>) AS ran), (s, t) -> {step})"
    return one.selectExpr("names", "a", "L", f"posexplode({fold}.ran) AS (slot, b)").selectExpr("names[b.i] AS _key", "a[b.i] AS a", "L", "b.k AS k", "cast(slot AS long) AS slot")


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def scheduled(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = None) -> DataFrame:
    """docs with _block, _place, _release, _deadline and _slot added."""
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = docs.withColumns({"_key": _key(source_col), "_hash": h, "_group": F.substring(h, 1, PREFIX)})
    order = ["_hash", F.col(id_col).asc_nulls_first(), *([F.xxhash64(F.col(text_col))] if text_col else [])]
    rows = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_group").orderBy(*order)).cast("long"))
    sizes = docs.select(_key(source_col).alias("_key"), F.substring(h, 1, PREFIX).alias("_group")).groupBy("_key", "_group").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("_key").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    plan = pattern(units(sizes.groupBy("_key").agg(F.sum("_size").alias("n")), weights))
    few = sizes.select("_key").distinct().limit(SENT + 1).count() <= SENT
    sent = F.broadcast if few else lambda df: df.hint("merge")
    share = plan.groupBy("_key").agg(F.first("a").alias("_a"), F.first("L").alias("_l"))
    before = before.join(sent(share), "_key")  # a row a source
    placed = rows.join(before, ["_key", "_group"]).withColumns({"_block": F.expr(f"(_before + _n - 1) div {block}"), "_place": F.expr(f"(_before + _n - 1) % {block}")})
    placed = placed.withColumns({"_period": F.expr("_block div _a"), "_k": F.expr("_block % _a")})
    slots = plan.select(F.col("_key").alias("_source"), F.col("k").alias("_unit"), F.col("slot").alias("_at"))
    placed = placed.join(sent(slots), (F.col("_key") == F.col("_source")) & (F.col("_k") == F.col("_unit")))  # a row a slot of one period
    out = placed.withColumns({"_release": F.expr("_period * _l + (_k * _l) div _a"), "_deadline": F.expr("_period * _l + ((_k + 1) * _l + _a - 1) div _a"), "_slot": F.expr("_period * _l + _at")})
    return out.drop("_key", "_hash", "_group", "_n", "_before", "_a", "_l", "_period", "_k", "_source", "_unit", "_at")


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, block, place, release, deadline, slot) of every row; slot, then place is the mixed order."""
    out = scheduled(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")), weights, block, "doc_id", "source")
    return out.select("doc_id", "source", *[F.col("_" + c).cast("long").alias(c) for c in ("block", "place", "release", "deadline", "slot")])


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs in the mixed order: partitions and the rows within them follow the schedule, and so do the files written from it."""
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))  # whatever other columns are called
    out = scheduled(whole, weights, block, "id", "source", "text")
    return out.repartitionByRange("_slot", "_place").sortWithinPartitions("_slot", "_place").select("doc.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS sk, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), weighed AS (
  SELECT sk, greatest(CAST(floor(sqrt(count(*))) AS BIGINT), 1) AS w FROM keyed GROUP BY sk
), sized AS (
  SELECT sk, w, {PERIOD} * ((count(*) OVER () + {PERIOD // 4 - 1}) // {PERIOD // 4}) AS per, count(*) OVER () AS n, CAST(sum(w) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY sk) - 1 AS i FROM weighed
), floored AS (
  SELECT *, 1 + ((per - n) * w) // total AS low, ((per - n) * w) % total AS rest FROM sized
), unit AS (
  SELECT sk, i, per, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, i) <= per - sum(low) OVER () THEN 1 ELSE 0 END AS a FROM floored
), arr AS (
  SELECT list(a ORDER BY i) AS a, list(sk ORDER BY i) AS names, max(per) AS per FROM unit
), run AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS pick, CAST(-1 AS BIGINT) AS unit_no, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done FROM arr
  UNION ALL
  SELECT t + 1, p, done[p], list_transform(done, lambda x, j: CASE WHEN j = p THEN x + 1 ELSE x END)
  FROM (
    SELECT run.t, run.done, list_min(list_transform(list_filter(range(1, len(arr.a) + 1), lambda j: (run.done[j] * arr.per) // arr.a[j] <= run.t + 1),
      lambda j: (((run.done[j] + 1) * arr.per + arr.a[j] - 1) // arr.a[j]) * 1000000 + j)) % 1000000 AS p
    FROM run, arr WHERE run.t + 1 < arr.per
  )
), slots AS (
  SELECT arr.names[pick] AS sk, unit_no AS k, t AS slot FROM run, arr WHERE t >= 0
), numbered AS (
  SELECT doc_id, source, sk, row_number() OVER (PARTITION BY sk ORDER BY h, doc_id) - 1 AS r FROM keyed
), placed AS (
  SELECT doc_id, source, sk, r // {BLOCK} AS block, r % {BLOCK} AS place FROM numbered
)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(place AS BIGINT) AS place,
  CAST((block // a) * per + ((block % a) * per) // a AS BIGINT) AS release,
  CAST((block // a) * per + ((block % a + 1) * per + a - 1) // a AS BIGINT) AS deadline,
  CAST((block // a) * per + slot AS BIGINT) AS slot
FROM placed JOIN unit USING (sk) JOIN slots ON slots.sk = placed.sk AND slots.k = block % a
"""
