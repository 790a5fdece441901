"""Word shingles of texts as sorted arrays of 64-bit hashes, computed over whole blocks of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1_000_000
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2 ** 64, up to the n-th."""
    if len(_POWERS[0]) <= n:
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(n + n // 4 + 1, p, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and how many words each text has."""
    joined = b"\n".join(raw) + b"\n"
    x = np.frombuffer(joined, np.uint8)
    up, down = _powers(len(x) + 1)
    space = _SPACE[x]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:], dtype=np.uint64)
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    stops = np.cumsum([len(r) + 1 for r in raw])
    n = np.diff(np.concatenate([[0], np.searchsorted(start, stops)]))
    return h, n


def sets(raw: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words after lower-casing A-Z; with fewer words, the whole sequence as one; without words, none."""
    i = 0
    while i < len(raw):
        part, n = [], 0
        while i < len(raw) and (n < BLOCK or not part):
            part.append(raw[i].lower())
            n += len(raw[i])
            i += 1
        h, words = word_hashes(part)
        odd = [np.uint64(2 * (0x1000193 ** (k + 2) % (1 << 62)) + 1) for k in range(size)]
        grams = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            grams += h[k : k + len(grams)] * odd[k]
        grams = mixed(grams)
        at = 0
        for w in words.tolist():
            if w >= size:
                yield np.unique(grams[at : at + w - size + 1])
            elif w:
                few = np.array([w], np.uint64)
                for k in range(w):
                    few = mixed(few * odd[k] + h[at + k : at + k + 1])
                yield few
            else:
                yield np.zeros(0, np.uint64)
            at += w
