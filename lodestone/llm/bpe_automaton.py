"""BPE by a tokenization automaton.

Compilation. The merge u v -> w of rank r is a gadget, a transducer of two states: in the first it passes every token on
but u, which it holds; in the second it holds u, and a v that arrives makes w, while anything else lets u go first. The
gadgets of all merges, one behind the other in order of their ranks, make every merge of BPE from left to right. A state
of their composition is the sequence of held tokens, each with the gadget that holds it; as a token that came later
is always held by an earlier gadget, a byte meets the held tokens from the last to the first, and its way is told by
the next gadget that would hold it alone. A token whose follower begins with none of what its gadget waits for goes on
at once, so that states that differ in nothing to come are one. The composition is deterministic: each pair of a state
and a byte has one arc to another state, which is labelled with the tokens that come out at the end.

The arcs are rows of a table, state and byte to state and tokens, which is composed as far as it is walked: over 50,000
merges the whole table has too many states to hold, and each arc of it is composed once by ``compose`` and looked up
from then on. ``complete`` composes the whole of it for small vocabularies. Encoding is one table look-up for each byte of a word
and one for its end, without a step back. Decoding emits the bytes that label each token.

Defined results: a null text counts as empty (no tokens); the special token's own string in a text becomes its id, as
the tokenizers library does; repeated rows and rows with a null or repeated id are encoded row by row; very long words
take one state at a time, like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batch, free_names, map_rows, table, texts_of

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Distinct words whose encodings a task remembers at once; of two such generations the older one goes. No word is left out.
REMEMBERED = 120_000
#: Arcs that a task's table holds; then it is emptied and composed anew from where it is walked. Prose of four languages needs about 400,000.
ARCS = 800_000
END = 256


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The gadgets of all merges, and the table of arcs that were composed from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model, to_byte = d["model"], _byte_chars()
        vocab = model["vocab"]
        labels = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        special = {t["content"]: t["id"] for t in d["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._set(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges], special)

    @classmethod
    def of(cls, labels: dict[int, bytes], merges: list[tuple[int, int, int]]) -> Automaton:
        """From the bytes of each token and merges (left, right, merged) in order of their ranks."""
        self = cls.__new__(cls)
        self._set(labels, merges, {})
        return self

    def _set(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]) -> None:
        self.special = special
        self.labels: list[bytes] = [b""] * (max([*labels, *special.values()]) + 1)
        for i, x in [*labels.items(), *((i, s.encode()) for s, i in special.items())]:
            self.labels[i] = x
        #: the token of each byte, and one that stands for the end, which no gadget knows
        self.token = [-1] * 256 + [len(self.labels)]
        for i, x in labels.items():
            if len(x) == 1:
                self.token[x[0]] = i
        #: of each token the gadgets that hold it; of two tokens (first << 20 | second) the gadgets that hold the first and may get to see what they wait for when the second follows, as it begins with that one
        holders: dict[int, list[int]] = {}
        meets: dict[int, list[int]] = {}
        begin: dict[int, int] = {}
        for u, _, w in merges:
            begin.setdefault(w, u)
        for r, (u, v, _) in enumerate(merges):
            holders.setdefault(u, []).append(r)
            while v is not None:
                meets.setdefault(u << 20 | v, []).append(r)
                v = begin.get(v)
        self.holders, self.meets = {k: tuple(v) for k, v in holders.items()}, {k: tuple(v) for k, v in meets.items()}
        self.waits, self.makes = [m[1] for m in merges], [m[2] for m in merges]
        self.clear()

    def clear(self) -> None:
        """Empties the table, but for the state that holds nothing. A state is a map: byte -> (next state, tokens), and at -1 what it holds: gadget << 20 | token, from the first to the last."""
        for state in getattr(self, "states", {}).values():
            state.clear()  # states refer to each other
        self.start: dict = {-1: ()}
        self.states: dict[tuple, dict] = {(): self.start}
        self.arcs = 0

    def _pass(self, held: list[int], out: list[int], x: int, after: int, follower: int | None) -> None:
        """Token x, behind gadget ``after`` and all held tokens, goes on as far as it gets; gadgets that would hold it in vain before the follower are left out."""
        waits = self.waits
        last = len(waits)
        while True:
            ranks = self.holders.get(x, ()) if follower is None else self.meets.get(x << 20 | follower, ())
            holds = last
            if ranks and ranks[-1] > after:
                holds = ranks[0] if ranks[0] > after else ranks[bisect_right(ranks, after)]
            if held and held[-1] >> 20 <= holds:
                u = held.pop()
                gadget = u >> 20
                if waits[gadget] == x:
                    x, after = self.makes[gadget], gadget
                    continue
                self._pass(held, out, u & 0xFFFFF, gadget, x)
                if gadget < holds:
                    after = gadget
                    continue
            if holds < last:
                held.append(holds << 20 | x)
            else:
                out.append(x)
            return

    def compose(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The arc of a state and a byte, put into the table."""
        held, out = list(state[-1]), []
        x = self.token[byte]
        if held:  # the last token learns what follows it
            u = held.pop()
            self._pass(held, out, u & 0xFFFFF, (u >> 20) - 1, x)
        self._pass(held, out, x, -1, None)
        if byte == END:
            out.pop()  # the end itself
        holds = tuple(held)
        to = self.states.get(holds)
        if to is None:
            to = self.states[holds] = {-1: holds}
        arc = state[byte] = (to, tuple(out))
        self.arcs += 1
        return arc

    def complete(self) -> int:
        """Composes all arcs of all states that can be reached; how many states there are."""
        known = [b for b in range(256) if self.token[b] >= 0] + [END]
        todo = [self.start]
        for state in todo:
            for b in known:
                n = len(self.states)
                to = state[b][0] if b in state else self.compose(state, b)[0]
                if len(self.states) > n:
                    todo.append(to)
        return len(self.states)

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of a word."""
        state, ids = self.start, []
        for b in word:
            try:
                state, out = state[b]
            except KeyError:
                state, out = self.compose(state, b)
            if out:
                ids += out
        ids += (state.get(END) or self.compose(state, END))[1]
        return ids

    def decode(self, ids) -> bytes:
        return b"".join([self.labels[i] for i in ids])


@lru_cache(maxsize=4)
def compiled(path: str) -> Automaton:
    return Automaton(path)


class Encoder:
    """Encodes texts, remembering the words it has met."""

    def __init__(self, automaton: Automaton):
        self.a, self.memo, self.older = automaton, {}, {}
        self.digits = [str(i) for i in range(len(automaton.labels))]
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(automaton.special, key=len, reverse=True)) + ")") if automaton.special else None

    def pieces(self, text: str) -> list[str]:
        """Pre-split words; a special token's string is a piece of its own."""
        special = self.a.special
        if self.splitter is None or not any(s in text for s in special):
            return SPLIT.findall(text)
        return [w for part in self.splitter.split(text) for w in ([part] if part in special else SPLIT.findall(part))]

    def learn(self, words: set[str]) -> None:
        """Afterwards memo holds for each word: ids as text, number of ids, bytes that they decode to."""
        if len(self.memo) > REMEMBERED:
            self.older, self.memo = self.memo, {}
        memo, older, digits, labels = self.memo, self.older, self.digits, self.a.labels
        for w in words:
            if w in memo:
                continue
            if w in older:
                memo[w] = older[w]
                continue
            ids = [self.a.special[w]] if w in self.a.special else self.a.encode_word(w.encode())
            memo[w] = (",".join([digits[i] for i in ids]), len(ids), b"".join([labels[i] for i in ids]))
        if self.a.arcs > ARCS:
            self.a.clear()

    def batches(self, texts: list[str], chars: int = 4_000_000):
        """Lists of memo entries, one list a text; the words of about ``chars`` characters are learnt together."""
        i = 0
        while i < len(texts):
            split, n = [], 0
            while i < len(texts) and (n < chars or not split):
                split.append(self.pieces(texts[i]))
                n += len(texts[i])
                i += 1
            self.learn(set().union(*split))
            memo = self.memo
            for words in split:
                yield [memo[w] for w in words]


def _encoder(path: str, held: list) -> Encoder:
    """The one in held, which each task has of its own: what it remembers goes with the task. No garbage is collected meanwhile: the many small maps would be gone through again and again."""
    if not held:
        gc.disable()
        held.append(Encoder(compiled(path)))
    return held[0]


def _forget(held: list) -> None:
    """Drops what a task has remembered, the table of arcs included."""
    for e in held:
        e.a.clear()
    held.clear()
    gc.enable()


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    held: list = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.fromstring(",".join([m[0] for m in e]), np.int32, sep=",") if e else [] for e in _encoder(path, held).batches(texts_of(b.column(1)))]
        return batch(_IDS, b.column(0), ids)

    return map_rows(_source(docs, id_col, text_col), run, "doc_id long, ids array<int>", lambda: _forget(held))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row; null ids count as none."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        a = compiled(path)
        return batch(_TEXT, b.column(0), [a.decode(ids or []).decode("utf-8", "replace") for ids in b.column(1).to_pylist()])

    return map_rows(encoded.select(F.col(id_col).cast("long"), F.col(ids_col)), run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row encoded, and decoded again from its ids: their number, a digest of the ids, a digest of the decoded text."""
    held: list = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, back = [], [], []
        for e in _encoder(path, held).batches(texts_of(b.column(1))):
            n.append(sum([m[1] for m in e]))
            ids.append(hashlib.sha256(",".join([m[0] for m in e]).encode()).hexdigest())
            raw = b"".join([m[2] for m in e])
            back.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
        return batch(_DIGEST, b.column(0), n, ids, back)

    return map_rows(_source(docs, id_col, text_col), run, DIGEST, lambda: _forget(held))


def encoded_in_order(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids for the text, and the place of each row in its input files: their order (file, block, row) is that of the rows as written. Names that docs has get underscores."""
    n_name, ids_name, file_name, block_name, row_name = free_names(docs, "n_tokens", "ids", "file", "block", "row")
    placed = docs.withColumns({file_name: F.element_at(F.split(F.input_file_name(), "/"), -1), block_name: F.input_file_block_start(), row_name: F.monotonically_increasing_id()})
    others = [c for c in placed.columns if c != text_col]
    held: list = []
    schema = placed.select(*others, F.lit(0).cast("long").alias(n_name), F.array(F.lit(0)).alias(ids_name)).schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[m[0] for m in e] for e in _encoder(path, held).batches(texts_of(b.column(text_col)))]
        ids = [np.fromstring(",".join(f), np.int32, sep=",") if f else np.zeros(0, np.int32) for f in found]
        columns = [b.column(c) for c in others] + [pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=[*others, n_name, ids_name])

    return map_rows(placed, run, schema, lambda: _forget(held))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_path())
