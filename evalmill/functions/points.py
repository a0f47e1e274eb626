"""Texts of an Arrow batch as code points, in bounded chunks of whole texts."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # code points at once; a longer text makes a chunk of its own


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text begins, with the end."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), first


def chunks(texts: list[str]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


@functools.cache
def spaces() -> np.ndarray:
    """Which code points are white space."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x3001) if chr(c).isspace()]] = True
    return out


def without(cps: np.ndarray, first: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without some code points; where texts begin then."""
    stay = np.concatenate([[0], np.cumsum(~gone)])
    return cps[~gone], stay[first]


@functools.cache
def classes(prefixes: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, list[str]]:
    """Of each code point the class of its letter, by what its Unicode name begins with, and the classes' names.

    0 is no letter, and the last class are letters of all others.
    """
    names = [*dict.fromkeys(c for _, c in prefixes), "Other"]
    number = {p: names.index(c) + 1 for p, c in prefixes}
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() and (name := unicodedata.name(ch, "")):
            out[c] = next((k for p, k in number.items() if name.startswith(p)), len(names))
    return out, names


_STEP, _ORDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(cps: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n neighbouring code points from each place on that stay in one text, and the text of each."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    k = len(cps) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(k, n, np.uint64) * _ORDER
    for i in range(n):
        h = (h ^ cps[i : i + k].astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(32)
    inside = owner[:k] == owner[n - 1 :]
    return h[inside], owner[:k][inside]
