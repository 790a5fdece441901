"""MinHash near-dedup: bottom-k sketches from one hash function.

Documents with equal shingle sets form a class and only its representative goes on. A sketch holds the K smallest hash
values of a set. Inverted lists of retained values generate overlaps: representatives that share WEIGHT of them are
candidates, the sketch of the union estimates their similarity and filters, and the full sets decide.

A list of at most HOT representatives is cold, and all cold values of a sketch are used. Candidates are not all pairs
of a list: first each member meets one leader alone; verified links give components; then members outside the
leader's component meet the members of other components. A pair left out joins documents that are connected already.

A sketch with fewer than ENOUGH cold values says too little: common passages or a large family of near copies make up
most of it. These representatives, and no others, are listed by their full sets as well, in the order cold values
first (values that at most HOT of them hold), then hot ones. A set of n values must share one of its first
n - ceil(n * percent / 100) + 1 with any set that is similar enough, so that these lists lose nothing and one common
value is enough for a candidate. Hot values come in only where a set holds too few cold ones. Two such sets without
a common cold value have at most the smaller number h of their hot values in common, which rules out most pairs by
(100 + percent) * h < percent * (sum of sizes); the leader of a hot list is the member whose values are the
most frequent, the likely middle of a family, so that its star holds nearly all of it. Each step is linear in the
length of a hot list, but for members that neither their leader's component nor that bound settles.

A pair of similarity 0.8 misses any one common value with 0.2, and with ENOUGH cold values of K (then at least 0.7 of
the cold ones are common) it shares fewer than WEIGHT with a probability under 1e-6.

Defined results: a null or empty text has an empty set, is linked with nothing and is kept; very long texts are read
whole, one at a time; a pair of exactly the similarity is linked; of a class or a component the smallest id stays, so
that there are no ties; repeated ids count as one
document with the union of links (the row count stays that of the input); an empty table gives an empty result; other
columns are ignored by ``near_duplicates`` and kept by ``deduplicated``. Null ids are linked with nothing and kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batch, map_rows, stored, table, texts_of
from lodestone.llm.components import components
from lodestone.llm.shingles import sets

K, HOT, ENOUGH, WEIGHT, SALTS = 40, 64, 16, 2, 8
#: Least estimate that is verified: over six deviations below 0.8 at K values.
LEAST = 0.4

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("sketch", pa.list_(pa.int64()))])
_SET = pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("set", pa.list_(pa.int64()))])


def _print(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, print, sketch): size of the set, its digest (null if empty), its K smallest hashes in unsigned order."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, prints, small = [], [], []
        for s in sets([t.encode() for t in texts_of(b.column(1))], words):
            n.append(len(s))
            prints.append(_print(s))
            small.append(s[:K].view(np.int64))
        return batch(_SKETCH, b.column(0), n, prints, small)

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, n long, print binary, sketch array<long>")


def full_sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(id, set) of nodes (id, doc_id, print), from texts (doc_id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = list(sets([t.encode() for t in texts_of(b.column(1))], words))
        return batch(_SET, b.column(0), [_print(s) for s in found], [s.view(np.int64) for s in found])

    found = map_rows(texts.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi"), run, "doc_id long, print binary, set array<long>")
    return found.join(nodes, ["doc_id", "print"]).groupBy("doc_id", "print").agg(F.first("id").alias("id"), F.first("set").alias("set")).select("id", "set")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (id, set) reach the similarity."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch(_LINKS, b.column(0), b.column(1)).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(found.select(F.col("id").alias("a"), F.col("set").alias("_x")), "a")
    return map_rows(one.join(found.select(F.col("id").alias("b"), F.col("set").alias("_y")), "b").select("a", "b", "_x", "_y"), run, "a long, b long")


def _estimated(pairs: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch, sizes included, doesn't rule the similarity out: of the K smallest values of the union, the share in both."""
    a, b = (small.select(F.col("id").alias(k), F.col("n").alias("_n" + k), F.col("sketch").alias("_s" + k)) for k in "ab")
    # unsigned order of the signed values: the sign bit flipped
    union = "slice(array_sort(transform(array_union(_sa, _sb), v -> v ^ (-9223372036854775807L - 1))), 1, least(greatest(size(_sa), size(_sb)), size(array_union(_sa, _sb))))"
    share = f"size(array_intersect({union}, transform(array_intersect(_sa, _sb), v -> v ^ (-9223372036854775807L - 1)))) >= {LEAST} * size({union})"
    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(_na, _nb) >= {percent} * greatest(_na, _nb)")
    return near.where(share).select("a", "b")


def _saturated(full: DataFrame, percent: int) -> DataFrame:
    """(v, id, first, weight, n, h, least) of full sets (id, set): the lists of the first values of each. h: hot values of the set, in hot lists only; least: the smallest size in the list."""
    values = full.select("id", F.explode("set").alias("v"))
    known = values.join(values.groupBy("v").agg(F.count("*").alias("c")), "v")
    ordered = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("s"))  # one set each
    ordered = ordered.selectExpr("id", "size(s) AS n", f"size(filter(s, x -> x.c > {HOT})) AS h", "aggregate(s, 0L, (t, x) -> t + x.c) / size(s) AS common", f"explode(slice(s, 1, size(s) - (size(s) * {percent} + 99) div 100 + 1)) AS x")
    kept = stored(ordered.where("x.c > 1").select("x.v", "x.c", "id", "n", "h", "common"), "prefixes")
    heads = kept.groupBy("v").agg(F.min("id").alias("low"), F.max_by("id", F.struct("common", -F.col("id"))).alias("middle"), F.min("n").alias("least"), F.count("*").alias("members")).where("members > 1")
    return kept.join(heads, "v").selectExpr("v", "id", f"if(c > {HOT}, middle, low) AS first", f"{WEIGHT} AS weight", "n", f"if(c > {HOT}, h, null) AS h", "least")


def _weighed(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lists weigh enough together."""
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("w")).where(f"w >= {WEIGHT}").select("a", "b")


def links(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) of every row, and (id, component) of every representative that has a link."""
    own = stored(sketches(docs, words, id_col, text_col), "sketches")
    reps = own.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    # the rows of one print are spread over SALTS tasks
    copied = reps.where("rep < last").select("print", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = own.select("doc_id", "n", "print", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(copied, ["print", "salt"], "left")
    members = members.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    # a class goes by the id of its representative, or by a hash where that id has several texts
    some = F.coalesce("print", F.lit(b""))
    several = stored(own.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.min(some).alias("_lo"), F.max(some).alias("_hi")).where("_lo < _hi").select("of"), "several")
    small = own.join(reps.select(F.col("print").alias("_p"), "rep"), (F.col("print") == F.col("_p")) & (F.col("doc_id") == F.col("rep"))).join(several, F.col("doc_id") == F.col("of"), "left")
    node = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "print"))
    small = stored(small.select(node.alias("id"), "doc_id", "print", "n", "sketch").dropDuplicates(["id"]), "representatives")
    nodes = small.select("id", "doc_id", "print")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # inverted lists
    values = small.select("id", F.explode("sketch").alias("v"))
    heads = values.groupBy("v").agg(F.count("*").alias("c"), F.min("id").alias("first")).where("c > 1")
    listed = stored(values.join(heads, "v"), "lists")
    hot = listed.where(f"c > {HOT}").groupBy("id").agg(F.count("*").alias("hot"))
    saturated = nodes.join(small.select("id", F.size("sketch").alias("k")).join(hot, "id").where(f"k - hot < {ENOUGH}").select("id"), "id", "left_semi")
    cold = listed.where(f"c <= {HOT}").selectExpr("v", "id", "first", "1 AS weight", "0 AS n", "cast(null AS int) AS h", "0 AS least")
    lists = stored(cold.union(_saturated(stored(full_sets(texts, saturated, words), "saturated"), percent)), "starred")
    # each member meets the leader of its list
    pairs = _weighed(lists.where("first <> id").selectExpr("least(first, id) AS a", "greatest(first, id) AS b", "v", "weight").distinct())
    near = stored(_estimated(pairs, small, percent), "near")
    first = stored(verified(near, _sets_of(near, texts, nodes, words), percent), "stars")
    label = components(first)
    # members that their leader doesn't reach meet the members of other components
    named = lists.join(label, "id", "left").select(*lists.columns, F.coalesce("component", "id").alias("of"))
    top = label.select(F.col("id").alias("first"), F.col("component").alias("top"))
    named = stored(named.join(top, "first", "left").withColumn("top", F.coalesce("top", "first")), "named")
    may = lambda h, n, m: f"({h} IS NULL OR {100 + percent} * {h} >= {percent} * ({n} + {m}))"
    apart = named.where("of <> top").where(may("h", "n", "least")).selectExpr("v", "id AS x", "of AS ox", "h AS hx", "n AS nx")
    cross = apart.join(named, "v").where("ox <> of AND x <> id").where(may("hx", "nx", "n")).where(may("h", "n", "nx"))
    cross = _weighed(cross.selectExpr("least(x, id) AS a", "greatest(x, id) AS b", "v", "weight").distinct()).join(pairs, ["a", "b"], "left_anti")
    near = stored(_estimated(cross, small, percent), "crossing")
    linked = first.union(verified(near, _sets_of(near, texts, nodes, words), percent))
    # an id with several texts ties their classes together
    names = nodes.where("id <> doc_id").select("id", F.col("doc_id").alias("_rep"))
    for k in "ab":
        linked = linked.join(names.withColumnRenamed("id", k), k, "left").withColumn(k, F.coalesce("_rep", k)).drop("_rep")
    ties = members.join(several, members.doc_id == several.of, "left_semi").where("rep <> doc_id").select("doc_id", "rep")
    return members, components(linked.select("a", "b").where("a <> b").union(ties))


def _sets_of(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The full sets of all that pairs hold."""
    of = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return stored(full_sets(texts, nodes.join(of, "id", "left_semi"), words), "sets")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    members, label = links(docs, words, percent, id_col, text_col)
    out = members.join(label, members.rep == label.id, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of all but the smallest id of each group; null ids stay."""
    gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
