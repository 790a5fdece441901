"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

All n-byte strings of all texts are hashed into buckets; the raw multinomial counts every document, the target
multinomial every document that is labelled as good. A text's score is the mean over its n-grams of
log(target / raw), both with add-half smoothing, so that it doesn't depend on length; a document is kept if no base
rule fails and its score reaches a fixed threshold.

Defined results: a null text has no words and fails the base rules; an id that is null or repeated, in documents or
in labels, is scored row by row (a document is trusted if any label of its id is good); with no trusted document at
all, both multinomials are uniform over what smoothing leaves and the score is that of the raw corpus against it;
a very long text is hashed as a whole, by itself; a score of exactly the threshold is kept; an empty table gives an empty result; other columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ROWS, batch, map_rows, release, small_batches, table, texts_of

BUCKETS, GRAM = 1 << 16, 4
#: Least mean log ratio of a text that is kept.
THRESHOLD = -0.5
#: Bits of the map of trusted ids that goes to every task: 1 MB.
MAP = 1 << 23
#: At most this many characters are hashed at once.
BLOCK = 1_000_000


def hashes(raw: bytes) -> np.ndarray:
    """The bucket of every GRAM-byte string of raw."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = x[:n] | (x[1 : n + 1] << np.uint32(8)) | (x[2 : n + 2] << np.uint32(16)) | (x[3 : n + 3] << np.uint32(24))
    return ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def blocks(raw: list[bytes]) -> Iterator[list[int]]:
    """Indexes of neighbouring texts, about BLOCK bytes together."""
    out, n = [], 0
    for i, r in enumerate(raw):
        out.append(i)
        n += len(r)
        if n >= BLOCK:
            yield out
            out, n = [], 0
    if out:
        yield out


def _counted(texts: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how often texts (one column) hold n-grams of each bucket, a row a task and bucket."""
    schema = pa.schema([("bucket", pa.int64()), (name, pa.int64())])

    def added(raw: list[bytes], total: np.ndarray) -> None:
        for part in blocks(raw):
            # a text is parted from the next so that no n-gram spans both: the strings over the seam are taken off again
            own = [raw[i] for i in part if len(raw[i]) >= GRAM]
            if own:
                h = hashes(b"".join(own))
                ends = np.cumsum([len(x) for x in own])[:-1]
                seam = (ends[:, None] - np.arange(1, GRAM)[None, :]).ravel()
                total += np.bincount(h, minlength=BUCKETS) - np.bincount(h[seam], minlength=BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                added([t.encode() for t in texts_of(b.column(0).slice(i, ROWS))], total)
        b = None
        at = np.flatnonzero(total)
        yield batch(schema, at, total[at])
        release()

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, f"bucket long, {name} long")


def _listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (_of, _text) of docs whose id is in ids (_id). A bit map of the ids, of MAP bits at any number of them, drops most others before texts are moved."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP))
    bits = ids.select(place("_id").alias("h")).groupBy(F.expr("h div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("_bits"))
    maybe = docs.withColumn("_h", place("_of")).join(F.broadcast(bits), F.expr("_h div 64 = _word"))  # at most MAP / 64 rows
    maybe = maybe.where("shiftright(_bits, cast(_h % 64 as int)) & 1 = 1").select("_of", "_text")
    # ids are distinct and grow with the corpus: one plan at every size; a semi join would be moved below the map
    return maybe.join(ids.hint("merge"), F.col("_of") == F.col("_id")).select("_of", "_text")


def bucket_counts(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): how often the texts of all documents, and of those whose id is in good, hold n-grams of each bucket. Each task sums up before the shuffle."""
    rows = docs.select(F.col(id_col).alias("_of"), F.col(text_col).cast("string").alias("_text"))
    listed = _listed(rows, good.select(F.col(id_col).alias("_id")).where("_id is not null").distinct())
    zero = F.lit(0).cast("long")
    both = _counted(rows.select("_text"), "raw").select("bucket", "raw", zero.alias("target")).union(_counted(listed.select("_text"), "target").select("bucket", zero, "target"))
    return both.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(target / raw) by bucket, from at most BUCKETS rows."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    p, q = raw + 0.5, target + 0.5
    return np.log(q / q.sum()) - np.log(p / p.sum())


def repeated_words(ids: list[int]) -> int:
    """How many words stand in 8-word windows that occur twice or more; the ranks of 2-, 4- and 8-word windows are exact."""
    if len(ids) < 9:
        return 0
    rank = np.array(ids, np.int64)
    for step in (1, 2, 4):
        if len(rank) <= step:
            return 0
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        values, rank = np.unique(pair, return_inverse=True)
        if len(values) == len(pair):
            return 0
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 8, -1)
    return int((np.cumsum(edge) > 0).sum())


def measures(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()  # bytes split at ASCII white space only
    chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    return len(words), chars, symbols, dup, repeated_words(ids)


def failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


def means(raw: list[bytes], ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text; 0 without an n-gram."""
    out = np.zeros(len(raw))
    for part in blocks(raw):
        own = [raw[i] for i in part]
        size = np.array([len(x) for x in own])
        v = np.concatenate([ratios[hashes(b"".join(own))], np.zeros(GRAM)])
        total = np.concatenate([[0.0], np.cumsum(v)])
        start = np.cumsum(size) - size
        n = np.maximum(size - GRAM + 1, 0)
        out[part] = np.where(n > 0, (total[np.minimum(start + n, len(v))] - total[start]) / np.maximum(n, 1), 0.0)
    return out


SCORE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
_SCORE = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("llr", pa.float64())])


def score(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base measures, score and verdict of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles, whatever the corpus

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(1))
        raw = [t.encode() for t in texts]
        llr = np.round(means(raw, sent.value), 9)
        rows = [measures(t, r) for t, r in zip(texts, raw, strict=True)]
        bad = [failed(r[0], r[4]) for r in rows]
        return batch(_SCORE, b.column(0), *(list(zip(*rows, strict=True)) or [[]] * 5), bad, [not f and bool(x >= threshold) for f, x in zip(bad, llr, strict=True)], llr)

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, SCORE)


def keep(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(text_col))
        raw = [t.encode() for t in texts]
        llr = np.round(means(raw, sent.value), 9)
        ok = []
        for t, r, x in zip(texts, raw, llr, strict=True):
            m = measures(t, r) if x >= threshold else None
            ok.append(m is not None and not failed(m[0], m[4]))
        return b.filter(pa.array(ok, pa.bool_()))

    return map_rows(docs, run, docs.schema)


def trusted_ratios(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """Fitted on all documents, with those labelled good as target."""
    return log_ratios(bucket_counts(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, trusted_ratios(spark, docs, sf_dir))
