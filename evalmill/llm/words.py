"""Words, word hashes and k-gram hashes over whole texts, in bounded blocks.

Texts come from Arrow as UTF-8 bytes; all word rules of this package cut at ASCII characters only, so they can work
on bytes, and whole blocks of documents go through numpy at once.  A block holds the words of several documents one
after another; ``first`` marks where each document begins, so that no k-gram crosses from one document into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Rule:
    """Which bytes make words, and whether A-Z become small letters first."""

    def __init__(self, outside: bytes, lower: bool):
        self.word = np.ones(256, bool)
        self.word[list(outside)] = False
        self.map = np.arange(256, dtype=np.uint8)
        if lower:
            self.map[65:91] += 32
        # the same rule for bytes.translate and bytes.split
        self.table = bytes(int(self.map[b]) if self.word[b] else 32 for b in range(256))


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
NOT_ALNUM = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
PLAIN = Rule(SPACES, lower=False)  # [^\x20\x09-\x0D]+
LOWER = Rule(SPACES, lower=True)
ALNUM = Rule(NOT_ALNUM, lower=True)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing

BLOCK_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers = np.ones(1, np.uint64)


def _places(n: int) -> np.ndarray:
    """Odd multipliers for the places 0..n-1 of a word."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def kgrams(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of the k words from each position on; k - 1 values shorter than ``h``.  ``second``: an independent one."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = _BASE2 if second else _STEP
    acc = mix(h[:n] ^ base)
    for i in range(1, k):
        acc *= base
        acc += h[i : n + i]
    return mix(acc)


@dataclass
class Block:
    rows: slice  # of the batch
    first: np.ndarray  # of each document: index of its first word; one more entry at the end
    hashes: np.ndarray  # of each word
    chars: np.ndarray  # of each word: code points

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word, which of the block's documents it belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.sizes)

    def inside(self, k: int) -> np.ndarray:
        """For each k-gram of the whole block: does it stay in one document?"""
        n = max(0, int(self.first[-1]) - k + 1)
        return np.arange(n) + k <= np.repeat(self.first[1:], self.sizes)[:n]


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as large binary; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).cast(pa.large_binary())


def ranges(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` (BLOCK_BYTES) bytes each; a longer text makes a range of its own."""
    limit = limit or BLOCK_BYTES
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n, base = 0, len(column), 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        base, start = int(ends[stop - 1]), stop


def parts(raw: np.ndarray, rule: Rule, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of some bytes: where each begins, sums of its bytes, its bytes, its code points.  at: where texts begin."""
    word = rule.word[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:-1]
    begins = np.flatnonzero(begin)
    if not len(begins):
        return begins, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    letters = rule.map[raw[word]]
    starts = np.flatnonzero(begin[word])
    lengths = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    value = _BYTE[letters]
    value *= _places(int(lengths.max()))[place]
    chars = np.add.reduceat((letters & 0xC0 != 0x80).astype(np.int64), starts)
    return begins, np.add.reduceat(value, starts), lengths, chars


def _long(raw: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and code points of the words of one text of any length, BLOCK_BYTES at a time; a word may go over several."""
    hashes: list[np.ndarray] = []
    points: list[np.ndarray] = []
    held = [0, 0, 0]  # sum, bytes and code points of the word at the end, which may go on
    for i in range(0, len(raw), BLOCK_BYTES):
        part = raw[i : i + BLOCK_BYTES]
        begins, sums, lengths, chars = parts(part, rule, np.zeros(1, np.int64))
        if held[1] and len(begins) and begins[0] == 0:  # goes on
            sums[0] = np.uint64((int(sums[0]) * pow(int(_BASE), held[1], 1 << 64) + held[0]) & ((1 << 64) - 1))
            lengths[0] += held[1]
            chars[0] += held[2]
        elif held[1]:
            hashes.append(mix(np.array([held[0]], np.uint64)))
            points.append(np.array([held[2]], np.int64))
        held = [0, 0, 0]
        if len(begins) and rule.word[part[-1]]:
            held = [int(sums[-1]), int(lengths[-1]), int(chars[-1])]
            sums, chars = sums[:-1], chars[:-1]
        hashes.append(mix(sums))
        points.append(chars)
    if held[1]:
        hashes.append(mix(np.array([held[0]], np.uint64)))
        points.append(np.array([held[2]], np.int64))
    return np.concatenate(hashes), np.concatenate(points)


def blocks(column: pa.Array, rule: Rule) -> Iterator[Block]:
    column = texts_of(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for start, stop in ranges(column):
        at = offsets[start : stop + 1] - offsets[start]
        raw = data[offsets[start] : offsets[stop]]
        if len(raw) > BLOCK_BYTES:  # one long text
            hashes, chars = _long(raw, rule)
            yield Block(slice(start, stop), np.array([0, len(hashes)]), hashes, chars)
            continue
        begins, sums, _, chars = parts(raw, rule, at)
        yield Block(slice(start, stop), np.searchsorted(begins, at).astype(np.int64), mix(sums), chars)


def winnow(grams: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Of every ``window`` neighbouring grams: the place of the smallest hash, the rightmost on ties; -1 where one of
    them is not valid.  Grams are valid within one document, so windows stay inside it."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = grams[:n].copy()
    at = np.zeros(n, np.int64)
    whole = valid[:n].copy()
    for i in range(1, window):
        now = grams[i : n + i]
        take = now <= best
        best[take] = now[take]
        at[take] = i
        whole &= valid[i : n + i]
    return np.where(whole, np.arange(n) + at, -1)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
