"""Vectorised words and word shingles of many texts at a time, in numpy.

A word is a run of bytes other than \\x20 and \\x09-\\x0D of the UTF-8 text.
Words hash to 64 bits by a polynomial over their bytes (an odd base has an
inverse modulo 2**64, so one running sum gives every word's value), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18
_BATCH = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), base, U)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """buf: all bytes; start, end: of each word in buf; doc: its text's index;
    first: index of the first word of each text, and the number of words."""

    def __init__(self, texts: list[bytes | None], lower: bool = True):
        joined = b"\n".join(x or b"" for x in texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        space = _SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.buf = _LOWER[buf] if lower else buf
        self.start, self.end = edge[0::2], edge[1::2]
        size = np.fromiter((len(x or b"") + 1 for x in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), U)
        i = 0
        while i < len(self):
            base = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, base + _CHUNK, "right")))
            stop = int(self.end[j - 1])
            up, down = _power(stop - base)
            total = np.zeros(stop - base + 1, U)
            np.cumsum((self.buf[base:stop].astype(U) + U(1)) * up, out=total[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = (total[e] - total[s]) * down[s]
            i = j
        return mix(out)


def batches(texts: list[bytes | None], most: int = _BATCH) -> Iterator[slice]:
    """Slices of texts of about `most` bytes, one text at least."""
    i = n = 0
    for j, x in enumerate(texts):
        if n and n + len(x or b"") > most:
            yield slice(i, j)
            i, n = j, 0
        n += len(x or b"") + 1
    if i < len(texts):
        yield slice(i, len(texts))


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every text, and the index of each
    text's first. A text of 1 to k-1 words has its whole sequence as one."""
    n = np.diff(first)
    out_n = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(out_n)])
    keys = [U((0x9E3779B97F4A7C15 * (2 * i + 1) + 0x632BE59BD9B4E019) & (2**64 - 1) | 1) for i in range(k)]
    total = np.zeros(len(h), U)
    for i in range(k):
        if len(h) > i:
            total[: len(h) - i] += h[i:] * keys[i]
    total = mix(total)
    valid = np.zeros(len(h), bool)
    starts = np.repeat(first[:-1], out_n) + (np.arange(at[-1]) - np.repeat(at[:-1], out_n))
    valid[starts] = True
    out = total[starts]
    for d in np.flatnonzero((n > 0) & (n < k)):
        a, b = first[d], first[d + 1]
        v = np.array([b - a], U) * U(0x5851F42D4C957F2D)
        for x in h[a:b]:
            v = mix(v ^ x) * U(0x2545F4914F6CDD1D)
        out[at[d]] = v[0]
    return out, at


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text."""
    out: list[np.ndarray] = []
    for part in batches(texts):
        w = Words(texts[part])
        g, at = grams(w.hashes(), w.first, k)
        for i in range(len(at) - 1):
            s = np.sort(g[at[i] : at[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out
