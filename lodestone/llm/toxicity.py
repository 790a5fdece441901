"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's bytes run through a bidirectional gated recurrent network whose states are pooled by attention; with a vector
of the word itself (for words of FREQUENT or more training rows; others are read by their characters alone) they are the
input of a second such network over windows of words. Its pooled state gives a window's score, and the highest window
decides for the text. Windows of WINDOW words start every STRIDE words, so that each passage of WINDOW - STRIDE + 1 words
lies in one of them whole, and all windows of whole texts are scored. Words are runs of letters, digits and non-ASCII
bytes, A-Z lower-cased; what is longer than PIECE bytes goes as several words of that length.

Training takes place in the driver on all windows of a bounded sample of rows: at most SAMPLE of each label, in order
of a hash of their ids. A row's windows share its label; after a first round the positive window is the one that the
network itself finds highest. The number of steps is fixed. WINDOW, STRIDE and HIDDEN were chosen by training on the
rows whose crc32 mod 5 is 2, 3 or 4 and looking at those where it is 1; the held-out rows (0) took no part in it.

Defined results: a null or empty text is one window of no words; a very long text is scored by pieces of about BLOCK
bytes that hold the same windows; of windows that tie for the highest any may decide, as their scores are equal, and a
score of exactly 0.5 is predicted toxic; a null or repeated id is scored row by row; an id with several labels is toxic
if any of them is; without labels of both kinds to learn from, every score is 0 (nothing is known to be toxic); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batch, map_rows, table, texts_of
from lodestone.llm.shingles import _powers, mixed

WINDOW, STRIDE, PIECE = 16, 8, 16
SAMPLE = 1500
LEXICON, FREQUENT, CHAR_IN, CHAR_STATE, WORD_IN, STATE, GAZE = 8192, 3, 8, 10, 8, 8, 8
ROUNDS, STEPS, BATCH, RATE, HIDDEN, DECAY, CLEAN, SEED = 8, 80, 48, 0.04, 0.8, 0.05, 3, 11
BLOCK, REMEMBERED = 400_000, 100_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, hash, words a text) of all words of all texts, in order."""
    x = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    inside = _LETTER[x]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    if len(start) and int((end - start).max()) > PIECE:
        n = -(-(end - start) // PIECE)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, end = np.repeat(start, n) + rank * PIECE, np.repeat(end, n)
        end = np.minimum(end, start + PIECE)
    up, down = _powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:], dtype=np.uint64)
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    stops = np.cumsum([len(r) + 1 for r in raw])
    return x, start, end, h, np.diff(np.concatenate([[0], np.searchsorted(start, stops)]))


def letters(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(words, longest) bytes of words, filled up with 0."""
    wide = int((end - start).max()) if len(start) else 1
    at = start[:, None] + np.arange(wide)
    return np.where(at < end[:, None], x[np.minimum(at, len(x) - 1)], 0)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, text) of all windows: places of words by window, -1 where there is none, for texts with these numbers of words."""
    n = np.maximum(1, 1 + -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    begin = (np.cumsum(counts) - counts)[text]
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < counts[text][:, None], begin[:, None] + at, -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Recurrent:
    """Both directions of one gated recurrent layer, with attention pooling of their states. Arrays run (direction, feature, row), so that each gate is one block."""

    def __init__(self, rng: np.random.Generator, size: int, state: int):
        f = np.float32
        self.state = state
        self.p = {
            "w": rng.normal(0, 1 / np.sqrt(size), (2, 3 * state, size)).astype(f),
            "u": rng.normal(0, 1 / np.sqrt(state), (2, 3 * state, state)).astype(f),
            "b": np.zeros((2, 3 * state, 1), f),
            "a": rng.normal(0, 1 / np.sqrt(2 * state), (GAZE, 2 * state)).astype(f),
            "c": np.zeros((GAZE, 1), f),
            "v": rng.normal(0, 1 / np.sqrt(GAZE), (1, GAZE)).astype(f),
        }

    def project(self, x: np.ndarray) -> np.ndarray:
        """(2, 3 * state, inputs) of distinct inputs (feature, input)."""
        return np.matmul(self.p["w"], x[None]) + self.p["b"]

    def forward(self, proj: np.ndarray, at: np.ndarray, here: np.ndarray, keep: bool = False):
        """Pooled states (2 * state, rows) of rows of inputs at[time, row]; here marks what attention may see."""
        (steps, n), s = at.shape, self.state
        h, u = np.zeros((2, s, n), np.float32), self.p["u"]
        states = np.empty((steps, 2 * s, n), np.float32)
        x, m = np.empty((2, 3 * s, n), proj.dtype), np.empty((2, 3 * s, n), np.float32)
        tape = []
        for t in range(steps):
            np.take(proj[0], at[t], axis=1, out=x[0], mode="clip")
            np.take(proj[1], at[steps - 1 - t], axis=1, out=x[1], mode="clip")
            np.matmul(u, h, out=m)
            gate = m[:, : 2 * s] + x[:, : 2 * s]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            z, r = gate[:, :s], gate[:, s:]
            new = r * m[:, 2 * s :]
            new += x[:, 2 * s :]
            np.tanh(new, out=new)
            if keep:
                tape.append((h, z, r, new, m[:, 2 * s :].copy()))
            h = h - new
            h *= z
            h += new
            states[t, :s] = h[0]
            states[steps - 1 - t, s:] = h[1]
        look = np.matmul(self.p["a"], states)
        look += self.p["c"]
        np.tanh(look, out=look)
        e = np.where(here, np.matmul(self.p["v"], look)[:, 0], np.float32(-1e9))
        e = np.exp(e - e.max(0)) * here
        weight = e / np.maximum(e.sum(0), np.float32(1e-9))
        pooled = np.zeros((2 * s, n), np.float32)
        for t in range(steps):
            pooled += states[t] * weight[t]
        return (pooled, (at, states, look, weight, tape)) if keep else pooled

    def backward(self, tape_, d: np.ndarray, inputs: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights but w and b, and that of the projections (2, 3 * state, inputs)."""
        at, states, look, weight, tape = tape_
        (steps, n), s = at.shape, self.state
        g = {"u": np.zeros_like(self.p["u"])}
        dw = (states * d).sum(1)
        de = weight * (dw - (weight * dw).sum(0))
        g["v"] = (look * de[:, None]).sum((0, 2))[None]
        dl = de[:, None] * self.p["v"].T * (1 - look * look)
        g["a"] = np.matmul(dl, states.transpose(0, 2, 1)).sum(0)
        g["c"] = dl.sum((0, 2))[:, None]
        ds = weight[:, None] * d + np.matmul(self.p["a"].T, dl)
        dx = np.empty((2, steps, 3 * s, n), np.float32)  # by place in time
        dh, ut = np.zeros((2, s, n), np.float32), self.p["u"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            dh[0] += ds[t, :s]
            dh[1] += ds[steps - 1 - t, s:]
            h, z, r, new, mn = tape[t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dnew * mn * r * (1 - r)
            dx[0, t], dx[1, steps - 1 - t] = np.concatenate([dz, dr, dnew], 1)
            dm = np.concatenate([dz, dr, dnew * r], 1)
            g["u"] += np.matmul(dm, h.transpose(0, 2, 1))
            dh = dh * z + np.matmul(ut, dm)
        order = np.argsort(at.ravel(), kind="stable")
        used, first = np.unique(at.ravel()[order], return_index=True)
        by_input = np.add.reduceat(dx.transpose(0, 2, 1, 3).reshape(2, 3 * s, -1)[:, :, order], first, axis=2)
        dproj = np.zeros((2, 3 * s, inputs), np.float32)
        dproj[:, :, used] = by_input
        return g, dproj


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.char, self.word = Recurrent(rng, CHAR_IN, CHAR_STATE), Recurrent(rng, 2 * CHAR_STATE + WORD_IN, STATE)
        self.top = {
            "chars": rng.normal(0, 1, (256, CHAR_IN)).astype(np.float32),
            "words": np.zeros((1, WORD_IN), np.float32),
            "pad": np.zeros((1, 2 * CHAR_STATE + WORD_IN), np.float32),
            "out": rng.normal(0, 1, 2 * STATE).astype(np.float32),
            "bias": np.full(1, -2, np.float32),
        }
        self.lexicon = np.zeros(0, np.uint64)
        self.parts = {"top": self.top, "char": self.char.p, "word": self.word.p}

    def learn_words(self, lexicon: np.ndarray) -> None:
        """Gives these words, by hash, vectors of their own; the last one, of all other words, stays 0."""
        self.lexicon = np.sort(lexicon)
        self.top["words"] = np.zeros((len(lexicon) + 1, WORD_IN), np.float32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Places of words in the lexicon, its length for others."""
        at = np.searchsorted(self.lexicon, h)
        if not len(self.lexicon):
            return at
        return np.where(self.lexicon[np.minimum(at, len(self.lexicon) - 1)] == h, at, len(self.lexicon))

    def read(self, chars: np.ndarray, keep: bool = False):
        """Pooled character states (feature, word) of words; chars: (words, longest) bytes."""
        at = np.ascontiguousarray(chars.T).astype(np.int64)
        return self.char.forward(self.char.project(self.top["chars"].T), at, at > 0, keep)

    def vectors(self, chars: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Inputs (word, feature) of the word network; words of like length are read together."""
        size = (chars > 0).sum(1)
        out = np.empty((len(chars), 2 * CHAR_STATE + WORD_IN), np.float32)
        for lo in range(0, PIECE, 2):
            mine = np.flatnonzero((size > lo) & (size <= lo + 2))
            for i in range(0, len(mine), 4096):
                k = mine[i : i + 4096]
                out[k, : 2 * CHAR_STATE] = self.read(np.pad(chars[k], ((0, 0), (0, max(0, lo + 2 - chars.shape[1]))))[:, : lo + 2]).T
        out[:, 2 * CHAR_STATE :] = self.top["words"][self.places(h)]
        return out

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return self.word.project(np.concatenate([self.top["pad"], vectors]).T)

    def logits(self, proj: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of windows; at: places in proj by window, 0 for none."""
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), 2048):
            part = np.ascontiguousarray(at[i : i + 2048].T)
            out[i : i + 2048] = self.top["out"] @ self.word.forward(proj, part, part > 0) + self.top["bias"]
        return out

    def gradients(self, chars: np.ndarray, bucket: np.ndarray, at: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Loss of windows and its gradients. chars, bucket: distinct words and their places in the lexicon; at: places in them plus 1, 0 for none."""
        read, tape = self.read(chars, True)
        inputs = np.concatenate([self.top["pad"].T, np.concatenate([read, self.top["words"][bucket].T])], 1)
        pooled, word_tape = self.word.forward(self.word.project(inputs), np.ascontiguousarray(at.T), at.T > 0, True)
        p = _sigmoid(self.top["out"] @ pooled + self.top["bias"])
        loss = -np.mean(np.log(np.where(label, p, 1 - p) + 1e-7))
        d = ((p - label) / len(label)).astype(np.float32)
        top = {"out": pooled @ d, "bias": d.sum(keepdims=True)}
        word, dproj = self.word.backward(word_tape, self.top["out"][:, None] * d, inputs.shape[1])
        word["w"], word["b"] = np.matmul(dproj, inputs.T[None]), dproj.sum(2, keepdims=True)
        din = np.matmul(self.word.p["w"].transpose(0, 2, 1), dproj).sum(0)
        top["pad"] = din[:, :1].T
        top["words"] = np.zeros_like(self.top["words"])
        np.add.at(top["words"], bucket, din[2 * CHAR_STATE :, 1:].T)
        top["words"][-1] = 0
        char, dproj = self.char.backward(tape, din[: 2 * CHAR_STATE, 1:], 256)
        char["w"], char["b"] = np.matmul(dproj, self.top["chars"][None]), dproj.sum(2, keepdims=True)
        top["chars"] = np.matmul(self.char.p["w"].transpose(0, 2, 1), dproj).sum(0).T
        return float(loss), {"top": top, "char": char, "word": word}


def vocabulary(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each different word, sorted, its letters, place of each word of all texts in these, words a text)."""
    hashes, values, chars, counts, i = [], [], [], [], 0
    while i < len(raw):
        part, n = [], 0
        while i < len(raw) and (n < BLOCK or not part):
            part.append(raw[i])
            n += len(raw[i])
            i += 1
        x, start, end, h, c = words_of(part)
        own, first = np.unique(h, return_index=True)
        spelt = letters(x, start[first], end[first])
        hashes.append(h)
        values.append(own)
        chars.append(np.pad(spelt, ((0, 0), (0, PIECE - spelt.shape[1]))))
        counts.append(c)
    known, first = np.unique(np.concatenate(values), return_index=True)
    return known, np.concatenate(chars)[first], np.searchsorted(known, np.concatenate(hashes)), np.concatenate(counts)


def fit(rows: list[tuple[bytes, int]], seed: int = SEED) -> Network | None:
    """A network from (text, label) of rows; None without rows of both labels."""
    if len({label for _, label in rows}) < 2:
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    values, chars, where, counts = vocabulary([text for text, _ in rows])
    at, row = windows_of(counts)
    at = np.where(at >= 0, where[np.maximum(at, 0)] + 1, 0) if len(where) else np.zeros_like(at)
    label = np.array([label for _, label in rows])[row]
    pairs = np.unique(np.column_stack([np.repeat(np.arange(len(counts)), counts), where]), axis=0)[:, 1] if len(where) else where
    seen = np.bincount(pairs, minlength=len(values))
    often = np.argsort(-seen, kind="stable")[:LEXICON]
    net.learn_words(values[often[seen[often] >= FREQUENT]])
    mean: dict = {}
    step = 0
    for turn in range(ROUNDS):
        if turn:
            score = net.logits(net.project(net.vectors(chars, values)), at)
        else:
            score = rng.random(len(at))
        order = np.lexsort((score, row))
        best = order[np.flatnonzero(np.append(row[order][1:] != row[order][:-1], True))]
        positive = best[label[best] == 1]
        hard = best[label[best] == 0]
        easy = np.flatnonzero(label == 0)
        for _ in range(STEPS):
            k = np.concatenate([rng.choice(positive, BATCH // 3), rng.choice(hard, BATCH // 3), rng.choice(easy, BATCH // 3)])
            used, place = np.unique(at[k], return_inverse=True)
            place = place.reshape(len(k), WINDOW) + (used[0] > 0)
            used = used[used > 0] - 1
            if not len(used):
                continue
            bucket = np.where(rng.random(len(used)) < HIDDEN, len(net.lexicon), net.places(values[used]))
            _, g = net.gradients(chars[used], bucket, place, label[k].astype(np.float32))
            step += 1
            rate = RATE * min(1.0, 2.0 * (1 - step / (ROUNDS * STEPS + 1)))
            for part, values_ in net.parts.items():
                for name, w in values_.items():
                    m, v = mean.setdefault((part, name), [np.zeros_like(w), np.zeros_like(w)])
                    d = g[part][name]
                    w *= np.float32(1 - rate * DECAY)
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # the bias is moved to where the rows' highest windows part with the least error, CLEAN times as bad for a clean row
    score = net.logits(net.project(net.vectors(chars, values)), at)
    order = np.lexsort((score, row))
    best = order[np.flatnonzero(np.append(row[order][1:] != row[order][:-1], True))]
    high, toxic = score[best], label[best] == 1
    cuts = np.sort(high)
    cuts = np.concatenate([cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1])
    missed = np.searchsorted(np.sort(high[toxic]), cuts) / toxic.sum()
    wrong = 1 - np.searchsorted(np.sort(high[~toxic]), cuts) / (~toxic).sum()
    cost = missed + CLEAN * wrong
    least = np.flatnonzero(cost <= cost.min() + 1e-12)
    net.top["bias"] -= np.float32(cuts[least].mean())
    return net


class Scorer:
    """Scores texts, remembering the words that it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.known = np.zeros(0, np.uint64)
        self.memo = np.zeros((0, 2 * CHAR_STATE + WORD_IN), np.float32)

    def vectors(self, h: np.ndarray, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Inputs of distinct words, h sorted."""
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        old = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        out = np.empty((len(h), self.memo.shape[1]), np.float32)
        out[old] = self.memo[at[old]]
        if not old.all():
            fresh = self.net.vectors(letters(x, start[~old], end[~old]), h[~old])
            out[~old] = fresh
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known, self.memo = h, out
            else:
                both = np.concatenate([self.known, h[~old]])
                order = np.argsort(both)
                self.known, self.memo = both[order], np.concatenate([self.memo, fresh])[order]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        cut = ((i, p) for i, t in enumerate(texts) for p in pieces(t.encode()))
        held, n = [], 0
        for i, p in cut:
            held.append((i, p))
            n += len(p)
            if n >= BLOCK:
                self.highest(held, out)
                held, n = [], 0
        if held:
            self.highest(held, out)
        return _sigmoid(out)

    def highest(self, held: list[tuple[int, bytes]], out: np.ndarray) -> None:
        """Raises out, by text, to the highest window of the (text, piece) in held."""
        x, start, end, h, counts = words_of([p for _, p in held])
        values, first, where = np.unique(h, return_index=True, return_inverse=True)
        proj = self.net.project(self.vectors(values, x, start[first], end[first]))
        at, piece = windows_of(counts)
        at = np.where(at >= 0, where[np.maximum(at, 0)] + 1, 0) if len(where) else np.zeros_like(at)
        np.maximum.at(out, np.array([i for i, _ in held])[piece], self.net.logits(proj, at))


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about BLOCK bytes whose windows are together those of the text."""
    at, size = 0, BLOCK
    while len(raw) - at > size:
        _, start, end, _, _ = words_of([raw[at : at + size]])
        windows = (len(start) - 1 - WINDOW) // STRIDE  # the last word may be cut, and one window at least is left for the next piece
        if windows < 1:
            size *= 2
            continue
        yield raw[at : at + int(end[(windows - 1) * STRIDE + WINDOW - 1])]
        at, size = at + int(start[windows * STRIDE]), BLOCK
    yield raw[at:]


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> list[tuple[bytes, int]]:
    """The bounded training sample: (whole text, label) of at most sample rows of each label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_of")).agg(F.max(label_col).cast("int").alias("_label"))
    picked = [known.where(F.col("_label") == v).orderBy(F.xxhash64("_of"), "_of").limit(sample) for v in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * sample ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, F.col("_id") == F.col("_of")).groupBy("_of").agg(F.first("_label").alias("_label"), F.max("_text").alias("_text"))
    got = sorted(map(tuple, rows.select(F.xxhash64("_of"), F.coalesce("_text", F.lit("")), "_label").collect()))  # the same order wherever rows lay
    return [(text.encode(), label) for _, text, label in got]


SCORE = "doc_id long, held_out boolean, score double, predicted int"
_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # the weights: about 300 KB
    held: list = []  # each task has a scorer of its own, and what it remembers goes with the task

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(2))
        if sent.value is None:
            s = np.zeros(len(texts))
        else:
            if not held:
                held.append(Scorer(sent.value))
            s = np.round(held[0].scores(texts), 6)
        return batch(_SCORE, b.column(0), b.column(1), s, (s >= 0.5).astype(np.int32))

    return map_rows(docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string")), run, SCORE, held.clear)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))
