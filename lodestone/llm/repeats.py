"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

A suffix array over all documents fits nowhere, so that suffixes are first dealt out by content. Among the GRAM-byte
strings of every LENGTH-byte string the one with the smallest hash (the leftmost of equals) is its anchor: a function
of the string alone, so that equal strings have equal anchors at equal places. Neighbouring strings with one anchor
form its region. Regions equal as a whole need no more than their hashes: all but the earliest are repeats. For an
anchor with different regions, the suffixes that start at it are sorted, the common prefixes of neighbours are scanned
with a stack, and each interval of the tree is scanned again over what precedes the anchor: where the left extensions
part, a maximal repeat ends, and the interval below holds all its occurrences. All of them but the earliest are removed
where left and right extension together reach LENGTH.

Where very many regions share an anchor (the borders of a passage that a great part of all documents hold), they take
the other way: each LENGTH-byte string of theirs is a row of its own, sorted by its hash and then its place, and all but
the first of each are removed; this holds no group in memory and gives the same bytes.

Defined results: a null text counts as empty; texts of fewer than LENGTH bytes are kept whole; a very long text is read
as a whole, by itself; of equal strings that of the smaller id, then place, is the earliest, so that there are no ties;
ids identify documents: rows with one id and equal texts get equal results (neither is earlier), and what is removed at a place of one row is
removed there in all rows with its id; rows with a null id are kept whole and compared with nothing; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import stored, table, texts_of
from lodestone.llm.shingles import _powers, mixed

LENGTH, GRAM = 100, 24
BLOCK = 1_500_000
#: Regions of one anchor in a block of one task beyond which they go string by string, and in all.
MANY, LIMIT = 8, 2000
#: States of a region; of a CROWD's anchor all regions are to go string by string.
DONE, OPEN, STRINGS, CROWD = 0, 1, 2, 3


def _prefix(x: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:], dtype=np.uint64)
    return total


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(total))
    return (total[end] - total[start]) * down[start]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Over a block of texts under 16 MB, or one text: index of the text, first and last string of each region in it, place of the anchor, hash of the anchor, hash of the region."""
    size = np.array([len(r) for r in raw], np.int64)
    x = np.frombuffer(b"".join(raw), np.uint8)
    none = np.zeros(0, np.int64)
    if len(x) < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    total = _prefix(x)
    at = np.arange(len(x) - GRAM + 1)
    h = mixed(_hash(total, at, at + GRAM))
    bits = max(24, int(len(x)).bit_length())
    key = (h >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    place = (_sliding_min(key, LENGTH - GRAM + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(raw)), np.maximum(size - LENGTH + 1, 0))
    first = np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0)
    s = begin[doc] + (np.arange(len(doc)) - first[doc])
    p = place[s]
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])) if len(s) else none
    last = np.concatenate([edge[1:], [len(s)]]) - 1 if len(s) else none
    lo, hi, p, doc = s[edge], s[last], p[edge], doc[edge]
    c = mixed(_hash(total, lo, hi + LENGTH) + ((hi - lo) * 128 + (p - lo)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return doc, lo - begin[doc], hi - begin[doc], p - begin[doc], h[p], c


def strings(raw: bytes, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each LENGTH-byte string that starts at lo to hi."""
    x = np.frombuffer(raw[lo : hi + LENGTH], np.uint8)
    at = np.arange(hi - lo + 1)
    a = mixed(_hash(_prefix(x), at, at + LENGTH))
    b = mixed(_hash(_prefix(x ^ np.uint8(0x5A)), at, at + LENGTH) * np.uint64(0x9FB21C651E98DF25))
    return a, b


def _packed(lo, hi, place):
    return lo * 65536 + (hi - lo) * 256 + (place - lo)


_ROW = pa.schema([("key", pa.int64()), ("region", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("state", pa.int32())])
ROW = "key long, region long, doc_id long, at long, state int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of rows with an id, about BLOCK bytes at once."""
    ids, raw, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            if i is None:
                continue
            ids.append(i)
            raw.append(t.encode())
            n += len(raw[-1])
            if n >= BLOCK:
                yield np.array(ids, np.int64), raw
                ids, raw, n = [], [], 0
    if ids:
        yield np.array(ids, np.int64), raw


def _spread(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(ids.astype(np.uint64) * np.uint64(31) + at.astype(np.uint64))


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a region, of those equal within the block only the earliest; the others are DONE. Rows that need no company are spread."""
    for ids, raw in _blocks(batches):
        doc, lo, hi, place, key, region = anchors(raw)
        if not len(doc):
            continue
        owner, at = ids[doc], _packed(lo, hi, place)
        order = np.lexsort((at, owner, region, key))
        key, region, owner, at = key[order], region[order], owner[order], at[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (region[1:] != region[:-1])])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        same_place = (owner == owner[head]) & (at == at[head])
        done = ~new & ~same_place
        # of many regions with one anchor, one stays to tell the other blocks' regions
        k, r, o, a = key[new], region[new], owner[new], at[new]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.concatenate([start, [len(k)]]))
        many = np.repeat(count > MANY, count)
        tells = np.zeros(len(k), bool)
        tells[start[count > MANY]] = True
        for kk, rr, oo, aa, state in ((_spread(owner[done], at[done]), np.zeros(done.sum(), np.uint64), owner[done], at[done], DONE), (k[~many], r[~many], o[~many], a[~many], OPEN), (k[tells], r[tells], o[tells], a[tells], CROWD), (_spread(o[many], a[many]), np.zeros(many.sum(), np.uint64), o[many], a[many], STRINGS)):
            if len(kk):
                yield pa.RecordBatch.from_arrays([pa.array(kk.view(np.int64)), pa.array(rr.view(np.int64)), pa.array(oo), pa.array(aa), pa.array(np.full(len(kk), state, np.int32))], schema=_ROW)


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, region, id and place: repeats of a region are DONE, the first of each region stays if its anchor has another region, and single rows go."""
    held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.int32)]
    over = None  # an anchor with more than LIMIT regions

    def out(c: list[np.ndarray], state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, c[:4]), pa.array(np.broadcast_to(np.asarray(state, np.int32), len(c[0])))], schema=_ROW)

    def settle(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        plain = (c[4] == OPEN) | (c[4] == CROWD)
        if not plain.all():
            yield out([x[~plain] for x in c], c[4][~plain])
            c = [x[plain] for x in c]
        key, region, doc, at, state_of = c
        if not len(key):
            return
        first_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = first_key | np.concatenate([[True], region[1:] != region[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        done = ~new & ((doc != doc[head]) | (at != at[head]))
        start = np.flatnonzero(first_key)
        n = np.add.reduceat(new.astype(np.int64), start)
        size = np.diff(np.concatenate([start, [len(key)]]))
        told = np.maximum.reduceat(state_of, start) == CROWD
        several = new & np.repeat((n > 1) | told, size)
        crowd = np.repeat((n > LIMIT) | told, size)
        for which, state in ((done, DONE), (several & ~crowd, OPEN), (several & crowd, STRINGS)):
            if which.any():
                yield out([x[which] for x in c], state)

    for b in batches:
        c = _columns(b)
        if not len(c[0]):
            continue
        if over is not None:
            more = c[0] == over
            if more.any():
                yield out([x[more] for x in c], np.where(c[4][more] == DONE, DONE, STRINGS))
                c = [x[~more] for x in c]
            if not len(c[0]):
                continue
            over = None
        held = [np.concatenate(x) for x in zip(held, c, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1]))
        yield from settle([x[:cut] for x in held])
        held = [x[cut:] for x in held]
        if len(held[0]) > 10 * LIMIT:
            over = int(held[0][0])
            yield out(held, np.where(held[4] == DONE, DONE, STRINGS))
            held = [x[:0] for x in held]
    if len(held[0]):
        yield from settle(held)


_PIECE = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])
PIECE = "key long, key2 long, doc_id long, at long, bytes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, rows): the bytes of OPEN regions (key2 0), and a row for each string of STRINGS regions (bytes null), the earliest of equals in a batch; places of the others go out as done (key2 null)."""
    for b in batches:
        rows, keys = [], []
        for i, t, regions in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if not regions:
                continue
            raw = (t or "").encode()
            for r in regions:
                lo, width = r["at"] >> 16, (r["at"] >> 8) & 255
                if lo + width + LENGTH > len(raw):
                    continue  # another row with this id
                if r["state"] == OPEN:
                    rows.append((r["key"], 0, i, r["at"], raw[lo : lo + width + LENGTH]))
                else:
                    x, y = strings(raw, lo, lo + width)
                    keys.append(np.column_stack([x.view(np.int64), y.view(np.int64), np.full(width + 1, i), np.arange(lo, lo + width + 1)]))
        if keys:
            k = np.concatenate(keys)
            k = k[np.lexsort((k[:, 3], k[:, 2], k[:, 1], k[:, 0]))]
            new = np.concatenate([[True], (k[1:, :2] != k[:-1, :2]).any(axis=1)])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            done = ~new & (k[:, 2:] != k[head, 2:]).any(axis=1)
            rows += [(a, c or 1, d, e, None) for a, c, d, e in k[new].tolist()]
            rows += [(int(_spread(np.array([d]), np.array([e])).view(np.int64)[0]), None, d, e, None) for _, _, d, e in k[done].tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(suffixes: list[bytes], order: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix interval tree of the sorted suffixes, by one stack scan: (common length, first, last) of each interval of two suffixes or more, children before parents."""
    stack: list[tuple[int, int]] = []  # (common length, left border)
    for i in range(1, len(order) + 1):
        n = common(suffixes[order[i - 1]], suffixes[order[i]]) if i < len(order) else -1
        left = i - 1
        while stack and stack[-1][0] > n:
            length, left = stack.pop()
            yield length, left, i - 1
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, left))


def maximal_repeats(texts: list[bytes], places: list[int], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through the given place of each text: (bytes before the place, bytes from it on, texts that hold it), of ``least`` bytes together or more."""
    right = [t[p:] for t, p in zip(texts, places, strict=True)]
    left = [t[:p][::-1] for t, p in zip(texts, places, strict=True)]
    order = sorted(range(len(texts)), key=right.__getitem__)
    for n, i, j in intervals(right, order):
        inside = order[i : j + 1]
        if n + max(len(left[k]) for k in inside) < least:
            continue
        # the interval again by what precedes the place: where left extensions differ, a repeat is maximal
        by_left = sorted(inside, key=left.__getitem__)
        for m, x, y in intervals(left, by_left):
            if m + n >= least:
                yield m, n, by_left[x : y + 1]


_COVER = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by key, key2, id and place: the byte ranges that repeat."""
    group: list[tuple] = []
    out: list[tuple[int, int, int]] = []
    first = None

    def flush() -> None:
        texts = [g[4] for g in group]
        places = [g[3] & 255 for g in group]
        rank = [(g[2], g[3]) for g in group]
        for m, n, members in maximal_repeats(texts, places, LENGTH):
            head = min(members, key=rank.__getitem__)
            for k in members:
                if rank[k] != rank[head]:
                    p = (rank[k][1] >> 16) + places[k]
                    # within one document an earlier occurrence is one that starts earlier
                    out.append((rank[k][0], p - m, p + n))
        group.clear()

    def places_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], schema=_COVER)

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            key, key2, doc, at, piece = row
            if key2 is None:
                out.append((doc, at, at + LENGTH))
            elif piece is None:
                if first is not None and first[:2] == (key, key2):
                    if first[2:] != (doc, at):
                        out.append((doc, at, at + LENGTH))
                else:
                    first = (key, key2, doc, at)
            else:
                if group and group[0][0] != key:
                    flush()
                group.append(row)
        if len(out) > 5000:
            yield places_of(out)
            out.clear()
    flush()
    if out:
        yield places_of(out)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, t, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            raw = (t or "").encode()
            gone = merged([(min(s["start"], len(raw)), min(s["end"], len(raw))) for s in spans or []])
            h, at, n = hashlib.sha256(), 0, 0
            for a, e in gone:
                h.update(raw[at:a])
                at, n = e, n + e - a
            h.update(raw[at:])
            rows.append((i, len(raw), n, sum(e > a for a, e in gone), h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _KEPT, strict=True)], schema=_KEPT)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end): byte ranges that, together, cover every byte of a LENGTH-byte string that also starts earlier."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    regions = texts.mapInArrow(_regions, ROW)
    found = stored(regions.repartition("key").sortWithinPartitions("key", "region", "doc_id", "at").mapInArrow(_shared, ROW), "regions")
    todo = found.where(f"state <> {DONE}").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("key", "at", "state")).alias("rows"))
    pieces = texts.join(todo, texts.doc_id == todo._id, "left").select("doc_id", "text", "rows").mapInArrow(_pieces, PIECE)
    more = pieces.repartition("key").sortWithinPartitions("key", "key2", "doc_id", "at").mapInArrow(_covered, "doc_id long, start long, end long")
    done = found.where(f"state = {DONE}").select("doc_id", F.expr("at div 65536").alias("start"), F.expr(f"at div 65536 + (at div 256) % 256 + {LENGTH}").alias("end"))
    return done.union(more)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_ranges(docs, id_col, text_col).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(spans, texts.doc_id == spans._id, "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
