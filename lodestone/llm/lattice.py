"""Embedding near-dedup by lattice hashing: projections decoded to E8 points, neighbouring cells probed, cosine verified.

A table projects the unit vector to BLOCKS times eight coordinates, each eight decoded to the nearest point of the E8
lattice; these points, with the label, are the vector's cell. Beside its own cell a vector enters the PROBES cells that
differ from it by the lattice step towards which the vector leans most, over all blocks. Vectors that meet in any cell
are compared in double precision. A pair of cosine 0.93 meets in one table with a probability of 0.62 and in none of
TABLES with 0.003; closer pairs are missed less still.

Equal vectors of one label form a class and only its representative (the smallest id) is hashed, with the number of
ids that it stands for. Cells that one representative alone enters are left out before any vector is moved. Larger
cells than CHUNK are cut into chunks by a hash of the id, and each pair of chunks is a task unit of its own, so that
no group is held as a whole. As every vector's links are to be counted, all different vectors of a cell meet, and a
cell of n of them sends each to n / CHUNK units. Inside a unit the cosines are a matrix product; what leaves it are sums by vector and a
star for each local component, never the pairs. A pair that meets in several cells counts in the one of the smallest
key. A product so near the threshold that its rounding matters is summed up again in a fixed order, so that the verdict
doesn't depend on the unit's shape; a cosine of exactly the threshold links.

Defined results: a null label, a null, empty or zero vector and one with null or non-finite components link with
nothing, count 0 links, are their own component and kept; vectors of different lengths are not compared; rows with one
id and equal vectors are one vector (the row count stays that of the input); rows with one id and different vectors
count their own links (to ids of other classes and to the other ids of their own) and share a component; a null id links with nothing and is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import stored, table
from lodestone.llm.components import components, stars
from lodestone.llm.shingles import mixed

COSINE, TABLES, BLOCKS, PROBES, WIDTH, CHUNK, SEED = 0.93, 6, 2, 4, 2.0, 1024, 8


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest steps of E8."""
    whole = [(i, j, s, t) for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    out = np.zeros((len(whole), 8))
    for k, (i, j, s, t) in enumerate(whole):
        out[k, i], out[k, j] = s, t
    half = np.array([h for h in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0])
    return np.concatenate([out, half])


def nearest(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row: the nearer of those of D8 and of D8 moved by a half."""

    def even(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        d = y - f
        at, k = np.arange(len(y)), np.abs(d).argmax(1)
        f[at, k] += np.where(f.sum(1) % 2 != 0, np.where(d[at, k] >= 0, 1.0, -1.0), 0.0)
        return f

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def projections(size: int) -> np.ndarray:
    """(TABLES, BLOCKS, size, 8), the same in every process."""
    return np.random.default_rng([SEED, size]).normal(size=(TABLES, BLOCKS, size, 8)) / WIDTH


def cells(unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(rows, TABLES * (1 + PROBES)) keys of the cells that each unit vector enters, its own cell of a table first."""
    n, size = unit.shape
    out = np.zeros((n, TABLES, 1 + PROBES), np.uint64)
    steps = roots()
    odd = mixed(np.arange(1, 8 * BLOCKS + 1, dtype=np.uint64)) | np.uint64(1)
    for t, blocks in enumerate(projections(size)):
        points, gains = [], []
        for a in blocks:
            y = unit @ a
            p = nearest(y)
            points.append(p)
            gains.append((y - p) @ steps.T)
        own = np.concatenate(points, 1)
        gain = np.concatenate(gains, 1)
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        salt = mixed(labels.astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)) + mixed(np.full(1, t * 65536 + size, np.uint64))
        for c in range(1 + PROBES):
            at = own.copy()
            if c:
                block, step = np.divmod(best[:, c - 1], len(steps))
                for b in range(BLOCKS):
                    m = block == b
                    at[m, 8 * b : 8 * b + 8] += steps[step[m]]
            code = (2 * at).astype(np.int64).view(np.uint64)
            out[:, t, c] = mixed((code * odd).sum(1, dtype=np.uint64) + salt)
    return out.reshape(n, -1)


def _valid(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors) for each length of vector that links at all. Columns: id, label, vector."""
    ok = b.column(0).is_valid().to_numpy(zero_copy_only=False) & b.column(1).is_valid().to_numpy(zero_copy_only=False) & b.column(2).is_valid().to_numpy(zero_copy_only=False)
    vectors = b.column(2)
    sizes = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    ok &= sizes > 0
    for size in np.unique(sizes[ok]):
        at = np.flatnonzero(ok & (sizes == size))
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)  # null components become NaN
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield at[good], x[good] + 0.0  # -0.0 equals 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither over- nor underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_PACKED = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])
PACKED = "id long, label long, vector binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row that links at all, its vector as bytes."""
    for b in batches:
        for at, x in _valid(b):
            if len(at):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([r.tobytes() for r in x], pa.binary())], schema=_PACKED)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of packed vector."""
    raw = column.to_pylist()
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, rep) for each cell that a representative enters. Columns: rep, label, vector."""
    schema = pa.schema([("cell", pa.int64()), ("rep", pa.int64())])
    for b in batches:
        reps, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
        for at, x in _vectors(b.column(2)) if b.num_rows else ():
            key = cells(_unit(x), labels[at])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(reps[at], key.shape[1]))], schema=schema)


_LOCAL = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
LOCAL = "kind int, a long, b long"
COUNT, LINK = 0, 1


#: Rows of small units that are compared together.
TOGETHER = 4096


def _compared(units: list[tuple[int, bool, list[tuple]]], cosine: float) -> Iterator[pa.RecordBatch]:
    """Units of (cell, whether two chunks meet, rows): counts by vector and stars. rows: (chunk side, rep, label, copies, vector bytes)."""
    by_size: dict[int, list[tuple[int, tuple]]] = {}
    for k, (_, _, rows) in enumerate(units):
        for r in rows:
            by_size.setdefault(len(r[4]), []).append((k, r))
    for group in by_size.values():
        unit = _unit(np.frombuffer(b"".join([r[4] for _, r in group]), np.float64).reshape(len(group), -1))
        side, rep, label, copies = (np.array([r[k] for _, r in group], np.int64) for k in range(4))
        of = np.array([k for k, _ in group])
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            crossed = units[of[lo]][1]
            first, second = (lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)) if crossed else (np.arange(lo, hi),) * 2
            if not len(first) or not len(second):
                continue
            product = unit[first] @ unit[second].T
            near = product >= cosine - 1e-9
            if not crossed:
                near = np.triu(near, 1)
            p, q = np.nonzero(near)
            if len(p):
                i, j = first[p], second[q]
                sure = product[p, q] > cosine + 1e-9
                sure[~sure] = (unit[i[~sure]] * unit[j[~sure]]).sum(1) >= cosine
                sure &= (label[i] == label[j]) & (rep[i] != rep[j])  # cells of two labels meet only if their keys collide
                left.append(i[sure])
                right.append(j[sure])
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            continue
        used = np.unique(np.concatenate([i, j]))
        place = np.zeros(len(group), np.int64)
        place[used] = np.arange(len(used))
        keys = cells(unit[used], label[used]).reshape(len(used), TABLES, -1)
        cell = np.array([c for c, _, _ in units], np.int64).view(np.uint64)[of]
        first_met = np.zeros(len(i), bool)
        for k in range(0, len(i), 20_000):
            x, y = keys[place[i[k : k + 20_000]]], keys[place[j[k : k + 20_000]]]
            met = (x[:, :, :, None] == y[:, :, None, :]).any(3)
            first_met[k : k + 20_000] = np.where(met, x, np.iinfo(np.uint64).max).min((1, 2)) == cell[i[k : k + 20_000]]
        i, j = i[first_met], j[first_met]
        if not len(i):
            continue
        total = np.zeros(len(group), np.int64)
        np.add.at(total, i, copies[j])
        np.add.at(total, j, copies[i])
        at = np.flatnonzero(total)
        a, b = stars(rep, i, j)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([COUNT, LINK], np.int32), [len(at), len(a)])), pa.array(np.concatenate([rep[at], a])), pa.array(np.concatenate([total[at], b]))], schema=_LOCAL)


def _units(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell, chunk u and chunk v: (cell, u, v, side, rep, label, copies, vector)."""
        now, held, ready, n = None, [], [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != now:
                    if len(held) > 1:
                        ready.append((now[0], now[1] != now[2], held))
                        n += len(held)
                    if n >= TOGETHER:
                        yield from _compared(ready, cosine)
                        ready, n = [], 0
                    now, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            ready.append((now[0], now[1] != now[2], held))
        if ready:
            yield from _compared(ready, cosine)

    return run


def near_duplicates(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col).cast("string"))).alias("label"), F.col(vector_col).alias("vector"))
    packed = stored(own.mapInArrow(_packed, PACKED).withColumn("print", F.sha2("vector", 256)), "vectors")
    members = packed.select("id", "label", "print").distinct()
    classes = members.groupBy("label", "print").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # a class goes by the id of its representative; further vectors under that id go by a hash
    first = classes.groupBy(F.col("rep").alias("_r")).agg(F.min(F.struct("label", "print")).alias("_first"))
    node = F.when(F.struct("label", "print") == F.col("_first"), F.col("rep")).otherwise(F.xxhash64("rep", "label", "print"))
    classes = stored(classes.join(first, F.col("rep") == F.col("_r")).select("label", "print", "rep", "copies", node.alias("node")), "classes")
    vectors = packed.select("id", F.col("label").alias("_l"), F.col("print").alias("_p"), "vector")
    reps = classes.join(vectors, (F.col("id") == F.col("rep")) & (F.col("label") == F.col("_l")) & (F.col("print") == F.col("_p")))
    reps = stored(reps.dropDuplicates(["node"]).select("node", "rep", "label", "print", "copies", "vector"), "representatives")
    entries = stored(reps.select("node", "label", "vector").mapInArrow(_entries, "cell long, rep long"), "entries")
    sizes = entries.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    dealt = entries.join(sizes, "cell").withColumn("chunks", F.expr(f"cast((n + {CHUNK - 1}) div {CHUNK} as int)")).withColumn("mine", F.expr("cast(pmod(xxhash64(rep, 7), chunks) as int)"))
    # each chunk meets itself and every other one: unit (u, v) with u <= v
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select("cell", F.least("mine", "other").alias("u"), F.greatest("mine", "other").alias("v"), F.expr("if(mine <= other, 0, 1)").alias("side"), F.col("rep").alias("_node"))
    units = dealt.join(reps, dealt._node == reps.node).select("cell", "u", "v", "side", F.col("node").alias("rep"), "label", "copies", "vector")
    found = stored(units.repartition("cell", "u", "v").sortWithinPartitions("cell", "u", "v").mapInArrow(_units(cosine), LOCAL), "found")
    counts = found.where(f"kind = {COUNT}").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    names = reps.select("node", "rep")
    linked = found.where(f"kind = {LINK}").join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # an id with several vectors ties their classes together
    named = members.join(classes.select("label", "print", "rep"), ["label", "print"]).select("id", "rep")
    several = named.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    ties = named.join(several, "id").select("a", F.col("rep").alias("b")).where("a < b")
    label = components(linked.union(ties)).withColumnRenamed("id", "_c")
    of_class = classes.join(counts, "node", "left").join(label, F.col("rep") == F.col("_c"), "left")
    of_class = of_class.select("label", "print", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linking = packed.select("id", "label", "print").join(of_class, ["label", "print"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    rest = own.mapInArrow(_invalid, "id long").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linking.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _invalid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of the rows that _packed leaves out."""
    for b in batches:
        rest = np.ones(b.num_rows, bool)
        for at, _ in _valid(b):
            rest[at] = False
        if rest.any():
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(rest))], names=["id"])


def deduplicated(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """rows without those of all but the smallest id of each component; null ids stay."""
    gone = near_duplicates(rows, cosine, id_col, vector_col, label_col).where("not kept").select(F.col("vec_id").alias("_gone")).distinct()
    return rows.join(gone, rows[id_col] == gone["_gone"], "left_anti")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
