"""Vectorised text primitives: code points, words and their hashes for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ALPHA, UPPER, DIGIT, SPACE, ALNUM = 1, 2, 4, 8, 16
BMP = 1 << 16


@cache
def classes() -> np.ndarray:
    """Flags of each code point of the basic plane; the others count as letters."""
    out = np.zeros(BMP + 1, np.uint8)
    for i in range(BMP):
        c = chr(i)
        out[i] = ALPHA * c.isalpha() | UPPER * c.isupper() | DIGIT * c.isdigit() | SPACE * c.isspace() | ALNUM * c.isalnum()
    out[BMP] = ALPHA | ALNUM
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, b)])) for b in (BASE, INVERSE))
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Points:
    """Code points of texts one after the other, each text ended by a 0."""

    cp: np.ndarray
    flags: np.ndarray
    starts: np.ndarray

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, dtype=np.int64) if len(self.starts) else np.zeros(0, np.int64)


def points(texts: list[str]) -> Points:
    joined = "\0".join(texts) + "\0" if texts else ""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return Points(cp, classes()[np.minimum(cp, BMP)], np.cumsum(sizes) - sizes)


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


@dataclass
class Words:
    """Hashes of the words (runs of letters and digits, lower case) of texts, in order."""

    h: np.ndarray
    text: np.ndarray  # number of the text of each word
    first: np.ndarray  # of each text, and the total at the end

    def __getitem__(self, i: int) -> np.ndarray:
        return self.h[self.first[i] : self.first[i + 1]]


def words(texts: list[str]) -> Words:
    p = points([t.lower() for t in texts])
    start, end = runs((p.flags & ALNUM) > 0)
    forward, back = powers(len(p.cp) + 1)
    with np.errstate(over="ignore"):
        reach = np.cumsum(mix(p.cp.astype(np.uint64) + BASE) * forward[: len(p.cp)])
        reach = np.concatenate([np.zeros(1, np.uint64), reach])
        h = mix((reach[end] - reach[start]) * back[start])
    text = np.searchsorted(p.starts, start, "right") - 1
    return Words(h, text, np.searchsorted(text, np.arange(len(texts) + 1)))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and the places where they're all of one text."""
    if len(w.h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w.h) - n + 1
    with np.errstate(over="ignore"):
        g = np.zeros(m, np.uint64)
        for j in range(n):
            g = g * BASE + w.h[j : j + m]
        g = mix(g)
    at = np.flatnonzero(w.text[:m] == w.text[n - 1 :])
    return g[at], at
