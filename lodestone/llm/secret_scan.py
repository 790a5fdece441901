"""Secret scans: pattern rules plus sliding-window Shannon entropy over candidate strings.

Defined results: a null or empty text has no span; repeated rows and null or repeated ids are scanned row by row; a very
long text takes time in proportion to its length; of spans that start at one place the order is that of KINDS; an empty
table gives an empty result; other columns of the input are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batch, map_rows, table, texts_of

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
ORDER = {k: i for i, k in enumerate(KINDS)}


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: class of characters -> (its runs, window, least entropy in bits of a window)
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0),
    "entropy_mixed": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.7),
}
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\Z")
#: What a part between separators looks like in plain words and numbers; random parts in both letter cases don't.
PLAIN = re.compile(r"(?:[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[A-Za-z]{0,2}[0-9]+[A-Za-z]{0,2})?")
SLUG = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+|[0-9]+)?")
PLACEHOLDER = re.compile(r"example|placeholder|your[-_]|changeme|xxxx|0000000|1234567890|abcdef012345", re.I)


def high_windows(run: str, width: int, least: float) -> list[tuple[int, int]]:
    """Merged [start, end) of all windows of run whose Shannon entropy is at least ``least``; counts are updated by one step a character."""
    n = len(run)
    if n < width:
        return []
    xlog = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: Counter = Counter(run[:width])
    total = sum(xlog[c] for c in counts.values())
    full, out = math.log2(width), []
    for i in range(n - width + 1):
        if i:
            a, b = run[i - 1], run[i + width - 1]
            if a != b:
                total += xlog[counts[a] - 1] - xlog[counts[a]] + xlog[counts[b] + 1] - xlog[counts[b]]
                counts[a] -= 1
                counts[b] += 1
        if full - total / width >= least - 1e-9:
            if out and i <= out[-1][1]:
                out[-1][1] = i + width
            else:
                out.append([i, i + width])
    return [tuple(x) for x in out]


def allowed(s: str) -> bool:
    """Whether the allow-list suppresses this string by itself: paths, UUIDs, placeholders, plain words, numbers and dates.

    Few digits or letters alone suppress nothing: every part between separators must look like a word or a number."""
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    parts = re.split(r"[/_=+-]+", s)
    if (digits < 3 or letters < 3) and all(map(PLAIN.fullmatch, parts)):
        return True
    if UUID.match(s) or PLACEHOLDER.search(s):
        return True
    # a path or a slug: many separators between words or plain numbers
    return len(parts) > 2 and all(map(SLUG.fullmatch, parts))


def unlinked(text: str) -> Iterator[tuple[int, int]]:
    """The candidates of text that no link holds. A link is a run without white space that starts with www. or has :// before the candidate."""
    at, linked = 0, False  # up to where the text is known, and whether a link goes on there
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        gap = text[at:a]
        tail = gap.split()[-1] if gap and not gap[-1].isspace() and not gap.isspace() else ""
        if len(tail) < len(gap):  # the run starts in the gap
            linked = False
            run = a - len(tail)
        else:
            run = 0 if at == 0 else None
        linked = linked or "://" in tail or (run is not None and text[run : run + 4].lower() == "www." and run < a)
        if not linked:
            yield a, b
        at = b


def _meets(spans: list[tuple[int, int]], x: int, y: int) -> bool:
    """Whether one of these disjoint spans in order meets [x, y)."""
    k = bisect_left(spans, (y,)) - 1
    return k >= 0 and spans[k][1] > x


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find(text: str, entropy: bool = True) -> list[tuple[int, int, str]]:
    """All (start, end, kind) in code points, sorted by start, then kind in the order of KINDS."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if entropy:
        base = _union([(a, b) for a, b, _ in out])
        for a, b in unlinked(text):
            if allowed(text[a:b]):
                continue
            taken: list[tuple[int, int]] = []
            for kind, (runs, width, least) in CLASSES.items():
                own = []
                for r in runs.finditer(text, a, b):
                    for x, y in high_windows(r.group(), width, least):
                        x, y = x + r.start(), y + r.start()
                        if not _meets(taken, x, y) and not _meets(base, x, y) and not allowed(text[x:y]):
                            own.append((x, y))
                            out.append((x, y, kind))
                taken = _union(taken + own)
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entropy: bool = True) -> DataFrame:
    """A row for every row of docs: counts of the base kinds, a digest of the base spans, and all spans."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            spans = find(t, entropy)
            base = [s for s in spans if ORDER[s[2]] < 3]
            n = Counter(s[2] for s in base)
            rows.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return batch(_SCAN, *(list(zip(*rows, strict=True)) or [[]] * 6))

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, SCAN)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """text with every maximal union of overlapping spans replaced by mark."""
    out, at = [], 0
    for a, b in _union([(a, b) for a, b, _ in find(text)]):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with all secrets of text_col replaced; a null text stays null; chars_col, if docs has it, becomes the new length of changed texts."""
    schema, names = docs.schema, docs.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        old = b.column(text_col).to_pylist()
        new = [t if t is None else redacted(t, mark) for t in old]
        columns = {n: b.column(n) for n in names}
        columns[text_col] = pa.array(new, b.schema.field(text_col).type)
        if chars_col in columns:
            was = columns[chars_col].to_pylist()
            columns[chars_col] = pa.array([w if x == y else len(y) for x, y, w in zip(old, new, was, strict=True)], b.schema.field(chars_col).type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], schema=b.schema)

    return map_rows(docs, run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
