"""Sum-of-squares online packing of token ids into sequences.

Each worker keeps an array with the number of open sequences at every fill level.  A document comes in whole sequences
as far as it goes; its rest is put where the sum of the squared counts over all levels becomes least: onto an open
sequence (that level loses one, the higher one gains one) or into a new one.  A sequence that becomes full is closed.

Cutting is free.  When more than ``open_limit`` sequences are open, and at the end, the contents of all open ones are
laid end to end and cut into full sequences; at the very end the remainder is cut into sequences whose lengths are
powers of two, so nothing needs padding.  Memory: at most ``open_limit`` sequences of ids, and a block of texts.

Sequence ids are the number of the input's partition and a count in it; work on a lost partition is done again with
the same result.  Null texts count as empty: the end token alone.  A null id is packed like any other; rows that repeat
an id are documents of their own.  Of levels with the same sum the fullest is taken.  Further columns play no part,
whatever their names.  An empty table gives no piece.  Ids are those of ``tokenizers`` with that file.
A text of any length is encoded LONG characters at a time; one unbroken word is encoded at once.
Repeated words are encoded once: a text of letters, digits and signs below U+0180 in normal form is cut at white space, and
only words not seen before are cut into the tokenizer's own pre-tokens and encoded; any other text is encoded as it stands.
Words are looked up by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import longs, prepared, tidied
from .words import LOWER, mix, parts, ranges, texts_of

SIZE, END, OPEN_LIMIT = 4096, 2, 1024
CACHE = 800_000  # words whose ids are kept; they take some 80 MB, for as long as the task
JOINED = 512  # pre-tokens that are encoded as one text
LONG = 1 << 20  # characters of a text that are encoded at once
MAX_FILE = 64 << 20
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _letters(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c)).startswith(kind))


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Token ids as little-endian 32-bit bytes, with a table of words for plain texts."""

    # The rule of this tokenizer file, for characters below U+0180 (fixed value).
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_letters('L')}]+|[{_letters('N')}]|[^\s{_letters('L')}{_letters('N')}]+")
    ODD = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]")  # also separators that not all libraries call space, and İ
    # What ``encode`` relies on, as the tokenizer file says it (fixed values).
    WORD_END = "</w>"
    NORMALIZER = {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    }
    CUTS = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        d = json.loads(definition)
        self.plain = self._is_plain(d)
        if self.plain:
            # the same model for what is normal and cut already
            lean = d | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, self.CUTS["pretokenizers"][1]]}}
            self.lean = Tokenizer.from_str(json.dumps(lean))
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # of the words, sorted; and where the ids of each begin, and how many there are
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, "<u4")
        self.pieces: dict[str, bytes] = {}

    def _is_plain(self, d: dict) -> bool:
        """Does the file cut and lower-case texts as PIECES expects?  Otherwise every text is encoded as it stands."""
        special = d["model"].get("end_of_word_suffix") == self.WORD_END and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in d["added_tokens"])
        return special and d["normalizer"] == self.NORMALIZER and d["pre_tokenizer"] == self.CUTS and d.get("post_processor") is None

    def _whole(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [_packed(e.ids) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._whole(texts)
        if max(map(len, texts), default=0) <= LONG:
            return self._cut(texts)
        return [b"".join(self._cut([part])[0] for part in _parts(t)) for t in texts]

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Texts are cut at white space, which no token spans; a word's ids are looked up by its hash."""
        odd = [i for i, t in enumerate(texts) if not t.isascii() and not unicodedata.is_normalized("NFC", t) or self.ODD.search(t) or "<|" in t]
        out: dict[int, bytes] = dict(zip(odd, self._whole([texts[i] for i in odd]), strict=True)) if odd else {}
        body = [b"" if i in out else t.encode() for i, t in enumerate(texts)]
        raw = np.frombuffer(b"".join(body), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(x) for x in body])])
        begins, sums, sizes, _ = parts(raw, LOWER, at)
        each, first, which = np.unique(mix(sums), return_index=True, return_inverse=True)
        if len(self.hashes) + len(each) > CACHE:
            self._forget()
        place = np.searchsorted(self.hashes, each)
        new = place == len(self.hashes)
        new[~new] = self.hashes[place[~new]] != each[~new]
        if new.any():
            some, n = begins[first[new]], sizes[first[new]] + 1
            letters = np.repeat(some - (np.cumsum(n) - n), n) + np.arange(n.sum())
            letters = raw[np.minimum(letters, len(raw) - 1)]
            letters[np.cumsum(n) - 1] = 32
            self._learn(each[new], letters[:-1].tobytes().decode().lower().split(" "))
            place = np.searchsorted(self.hashes, each)
        start, count = self.start[place][which], self.count[place][which]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(start - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        edges = (4 * upto[np.searchsorted(begins, at)]).tolist()
        return [out[i] if i in out else ids[edges[i] : edges[i + 1]] for i in range(len(texts))]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        cut = [(w,) if w.isalpha() else self.PIECES.findall(w) for w in words]  # letters alone are one pre-token
        new = list(dict.fromkeys(p for x in cut for p in x if p not in self.pieces))
        self.pieces.update(zip(new, self._piece_ids(new), strict=True))
        ids = [b"".join([self.pieces[p] for p in x]) for x in cut]
        count = np.array([len(x) // 4 for x in ids], np.int64)
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.start, self.count = (np.insert(x, place, y) for x, y in ((self.hashes, hashes), (self.start, start), (self.count, count)))

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token, many to a text: the last id of each tells where it ends."""
        out: list[bytes] = []
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        for some, data in zip(groups, self._whole([" ".join(g) for g in groups], self.lean), strict=True):
            ends = 4 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1)
            if len(ends) != len(some) or len(data) and ends[-1] != len(data):
                out += self._whole(some)
                continue
            stops = ends.tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about LONG characters that end with a space or a line end, which no token spans."""
    start = 0
    while len(text) - start > LONG:
        stop = max(text.rfind(c, start, start + LONG) for c in " \n") + 1
        if not stop:  # a longer word
            later = [i for c in " \n" if (i := text.find(c, start)) >= 0]
            stop = min(later) + 1 if later else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:]


class Packer:
    """Places documents one after another; ``put`` and ``finish`` give rows of finished sequences."""

    def __init__(self, size: int = SIZE, open_limit: int = OPEN_LIMIT, first_id: int = 0):
        self.size, self.open_limit, self.next_id = size, open_limit, first_id
        self.levels = np.zeros(size + 1, np.int64)
        self.at: list[list[list[tuple]]] = [[] for _ in range(size)]  # open sequences by level: lists of pieces
        self.n_open = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next_id, offset
            offset += n
        self.next_id += 1

    def best(self, n: int) -> int:
        """The level to put n tokens on: that with the least sum of squares afterwards; 0 opens a sequence.  On ties
        the fullest."""
        top = self.size - n
        open_ = np.flatnonzero(self.levels[1 : top + 1]) + 1
        levels = np.concatenate([[0], open_])
        change = 2 * self.levels[levels + n] + 1
        change[levels + n == self.size] = 0  # a full sequence is closed
        change[1:] += 1 - 2 * self.levels[open_]
        return int(levels[len(levels) - 1 - np.argmin(change[::-1])])

    def put(self, doc: object, ids: bytes) -> Iterator[tuple]:
        total, step = len(ids) // 4, 4 * self.size
        whole = total // self.size * self.size
        for start in range(0, whole, self.size):
            yield from self._close([(doc, start, ids[4 * start : 4 * start + step], total)])
        n = total - whole
        if not n:
            return
        piece = (doc, whole, ids[4 * whole :], total)
        level = self.best(n)
        pieces = [piece]
        if level:
            pieces = self.at[level].pop()
            pieces.append(piece)
            self.levels[level] -= 1
            self.n_open -= 1
        if level + n == self.size:
            yield from self._close(pieces)
            return
        self.at[level + n].append(pieces)
        self.levels[level + n] += 1
        self.n_open += 1
        if self.n_open > self.open_limit:
            yield from self._join(last=False)

    def _join(self, last: bool) -> Iterator[tuple]:
        """Lays open sequences end to end and cuts them anew; what is left stays open, or ends in powers of two."""
        row: list[tuple] = []
        fill = 0
        left = int((self.levels * np.arange(self.size + 1)).sum())
        room = self.size
        for level in range(self.size - 1, 0, -1):
            for pieces in self.at[level]:
                for doc, start, ids, total in pieces:
                    while ids:
                        if not row and left < self.size and last:
                            room = 1 << (left.bit_length() - 1)
                        n = min(room - fill, len(ids) // 4)
                        row.append((doc, start, ids[: 4 * n], total))
                        start, ids, fill, left = start + n, ids[4 * n :], fill + n, left - n
                        if fill == room:
                            yield from self._close(row)
                            row, fill = [], 0
            self.at[level] = []
        self.levels[:] = 0
        self.n_open = 0
        if row:
            self.at[fill].append(row)
            self.levels[fill] = self.n_open = 1

    def finish(self) -> Iterator[tuple]:
        yield from self._join(last=True)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    size: int = SIZE,
    end: int | None = END,
    open_limit: int = OPEN_LIMIT,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a ``tokenizers`` file on the driver; workers get its text, which is at most 64 MB.
    """
    spark = prepared(docs.sparkSession)
    path = Path(tokenizer or default_tokenizer())
    if path.stat().st_size > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    definition = spark.sparkContext.broadcast(path.read_text(encoding="utf-8"))
    tail = b"" if end is None else np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition.value)
        packer = Packer(size, open_limit, TaskContext.get().partitionId() << 40)
        for batch in batches:
            body, ids = texts_of(batch.column("text")).cast(pa.large_string()), batch.column("doc_id").to_pylist()
            for start, stop in ranges(body):
                rows: list[tuple] = []
                for doc, tokens in zip(ids[start:stop], encoder.encode(body.slice(start, stop - start).to_pylist()), strict=True):
                    rows += packer.put(doc, tokens + tail)
                if rows:
                    yield _rows(rows)
        rows = list(packer.finish())
        if rows:
            yield _rows(rows)

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return columns.mapInArrow(tidied(run), ", ".join(f"{n} long" for n in NAMES))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], NAMES)
