"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` neighbouring k-grams the one with the smallest hash is a fingerprint, so every span of
``window`` words holds at least one.  Fingerprints of documents meet those of benchmark items, and each meeting is
extended word by word in both directions; a document word is hit when it lies in a run of ``window`` equal words.
Items shorter than ``window`` words are fingerprinted whole.

A benchmark of up to ``broadcast_bytes`` of text goes to every worker, and documents are read once without any
shuffle.  A larger one is joined with the documents on their fingerprints; each document then meets only the items
it shares a fingerprint with, in the same matching code.

Null and empty texts have no words: nothing is hit.  Items without words match nothing; without any item nothing is
hit, and without documents there are no rows.  Repeated item ids count once.  Every row of documents is judged alone.  Words are compared by 64-bit hashes; a wrong hit needs ``window`` neighbouring collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import annotate, longs, prepared, tidied
from .words import ALNUM, Block, Rule, blocks, cover, kgrams, winnow

WINDOW, K = 13, 7
BROADCAST_BYTES = 16 << 20
PAIRS = 200_000  # meetings compared at once
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
]


class Index:
    """Benchmark items by fingerprint."""

    def __init__(self, ids: list[str | None], texts: pa.Array, rule: Rule = ALNUM, window: int = WINDOW, k: int = K):
        self.ids, self.window, self.k, self.rule = ids, window, k, rule
        parts = list(blocks(texts, rule))
        self.words = np.concatenate([b.hashes for b in parts] or [np.empty(0, np.uint64)])
        sizes = np.concatenate([b.sizes for b in parts] or [np.empty(0, np.int64)])
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        whole = Block(slice(0, len(sizes)), self.first, self.words, self.words)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        marks = winnow(kgrams(self.words, k), whole.inside(k), window - k + 1)
        self.anchors = self._sorted(kgrams(self.words, k), np.unique(marks[marks >= 0]))
        for n in np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist():
            self.by_width[n] = self._sorted(kgrams(self.words, n), self.first[:-1][sizes == n])

    @staticmethod
    def _sorted(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(grams[at], kind="stable")
        return grams[at][order], at[order]

    @staticmethod
    def _meet(keys: np.ndarray, at: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a document place and an item place with the same hash, some at a time."""
        lo, hi = np.searchsorted(index[0], keys, "left"), np.searchsorted(index[0], keys, "right")
        found = np.flatnonzero(hi > lo)
        counts = (hi - lo)[found]
        ends = np.cumsum(counts)
        start = 0
        while start < len(found):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            n = counts[start:stop]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at[found[start:stop]], n), index[1][np.repeat(lo[found[start:stop]], n) + inner]
            start = stop

    def match(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the block that an item has: document, item, first word, width."""
        h, owner, w = block.hashes, block.owner(), self.window
        out: list[tuple[np.ndarray, ...]] = []
        marks = winnow(kgrams(h, self.k), block.inside(self.k), w - self.k + 1)
        marks = np.unique(marks[marks >= 0])
        before = w - self.k
        if len(marks) and len(self.anchors[0]):
            reach = np.arange(-before, w)
            for p, q in self._meet(kgrams(h, self.k)[marks], marks, self.anchors):
                mine, its = p[:, None] + reach, q[:, None] + reach
                ok = (mine >= block.first[owner[p]][:, None]) & (mine < block.first[owner[p] + 1][:, None])
                ok &= (its >= self.first[self.item[q]][:, None]) & (its < self.first[self.item[q] + 1][:, None])
                same = ok & (h[np.where(ok, mine, 0)] == self.words[np.where(ok, its, 0)])
                run = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
                pair, off = np.nonzero(run[:, w:] - run[:, :-w] == w)
                out.append((owner[p[pair]], self.item[q[pair]], p[pair] - before + off, np.full(len(pair), w)))
        for n, index in self.by_width.items():
            grams = kgrams(h, n)
            at = np.flatnonzero(block.inside(n))
            for p, q in self._meet(grams[at], at, index):
                same = (h[p[:, None] + np.arange(n)] == self.words[q[:, None] + np.arange(n)]).all(axis=1)
                out.append((owner[p[same]], self.item[q[same]], p[same], np.full(int(same.sum()), n)))
        if not out:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def judge(self, texts: pa.Array) -> tuple[list[int], list[int], list[list[str]]]:
        """Of each text: number of words, of hit words, and the items found, as strings in order."""
        n_words: list[int] = []
        n_hit: list[int] = []
        items: list[list[str]] = []
        for block in blocks(texts, self.rule):
            doc, item, start, width = self.match(block)
            hit = np.zeros(int(block.first[-1]), bool)
            for n in np.unique(width).tolist():
                hit |= cover(np.unique(start[width == n]), n, len(hit))
            found: list[set[str]] = [set() for _ in range(len(block.sizes))]
            for pair in np.unique(doc * len(self.ids) + item).tolist():
                if (name := self.ids[pair % len(self.ids)]) is not None:
                    found[pair // len(self.ids)].add(name)
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_words += block.sizes.tolist()
            n_hit += (sums[block.first[1:]] - sums[block.first[:-1]]).tolist()
            items += [sorted(x, key=lambda s: s.encode()) for x in found]
        return n_words, n_hit, items


def _arrays(judged: tuple[list[int], list[int], list[list[str]]]) -> list[pa.Array]:
    return [longs(judged[0]), longs(judged[1]), pa.array(judged[2], pa.list_(pa.string()))]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = K,
    rule: Rule = ALNUM,
    broadcast_bytes: int = BROADCAST_BYTES,
    need: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_words, n_hit and items (ids of the items that have a window in the text).

    Columns of ``docs`` with these names are replaced.  Words of items with a null id are hit as others are; only the list of
    items lacks them.
    """
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and window")
    spark = prepared(docs.sparkSession)
    items = benchmark.select(
        F.col(item_col).cast("string").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("body")
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("body") + F.coalesce(F.octet_length("id"), F.lit(0)) + 16), F.lit(0))).first()[0]
    if total <= broadcast_bytes:
        rows = items.collect()  # at most broadcast_bytes
        sent = spark.sparkContext.broadcast(
            Index([r.id for r in rows], pa.array([r.body for r in rows], pa.string()), rule, window, k)
        )
        return annotate(docs, FIELDS, lambda batch: _arrays(sent.value.judge(batch.column(text_col))), need)
    return _joined(docs, items, text_col, window, k, rule, need)


def _joined(docs: DataFrame, items: DataFrame, text_col: str, window: int, k: int, rule: Rule, need: list[str] | None) -> DataFrame:
    """The same for a benchmark of any size: only items that share a fingerprint with a document reach it."""
    spark = docs.sparkSession
    keyed = docs.withColumn("_body", F.coalesce(F.col(text_col), F.lit("")))
    keyed = keyed.withColumn("_key", F.sha2("_body", 256))
    widths = sorted(r[0] for r in _lengths(items, rule).where(f"n > 0 and n < {window}").select("n").distinct().collect())  # fewer than window values

    def marks(batches: Iterator[pa.RecordBatch], short: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for block in blocks(batch.column(1), rule):
                owner, h = block.owner(), block.hashes
                rows, prints = [], []
                at = winnow(kgrams(h, k), block.inside(k), window - k + 1)
                at = np.unique(at[at >= 0])
                rows.append(owner[at])
                prints.append(kgrams(h, k)[at])
                for n in widths:
                    inside = block.inside(n)
                    if not short:
                        inside = inside & (block.sizes == n)[owner[: len(inside)]]
                    rows.append(owner[: len(inside)][inside])
                    prints.append(kgrams(h, n)[inside] + np.uint64(n))
                row, mark = np.concatenate(rows), np.concatenate(prints)
                pairs = np.unique(np.rec.fromarrays([row, mark]))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(pairs.f0 + block.rows.start)), longs(np.ascontiguousarray(pairs.f1))], ["key", "mark"]
                )

    texts = keyed.select("_key", "_body").dropDuplicates(["_key"])
    schema = "key string, mark long"
    ours = texts.mapInArrow(tidied(lambda b: marks(b, True)), schema)
    theirs = items.mapInArrow(tidied(lambda b: marks(b, False)), schema).select(F.col("key").alias("id"), "mark")
    met = ours.join(theirs, "mark").select("key", "id").distinct()
    met = met.join(items.withColumnRenamed("id", "item"), F.col("id").eqNullSafe(F.col("item"))).drop("item").groupBy("key").agg(F.collect_list(F.struct("id", "body")).alias("_items"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for body, found in zip(batch.column("_body"), batch.column("_items").to_pylist(), strict=True):
                index = Index([x["id"] for x in found or []], pa.array([x["body"] for x in found or []], pa.string()), rule, window, k)
                for column, value in zip(out, index.judge(pa.array([body.as_py()], pa.string())), strict=True):
                    column += value
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *_arrays(tuple(out))], ["_key", *(f.name for f in FIELDS)])

    judged = texts.join(met, texts["_key"] == met["key"], "left").select("_key", "_body", "_items").mapInArrow(
        tidied(judge), T.StructType([T.StructField("_key", T.StringType()), *FIELDS])
    )
    names = [f.name for f in FIELDS]
    kept = [c for c in docs.columns if c not in names and (need is None or c in need)]
    return keyed.select(*kept, "_key").join(judged, "_key").select(*kept, *names)


def _lengths(items: DataFrame, rule: Rule) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("body"), rule):
                yield pa.RecordBatch.from_arrays([longs(block.sizes)], ["n"])

    return items.mapInArrow(tidied(count), "n long")


def verdict(judged: DataFrame) -> DataFrame:
    """n_items, items_sha256 and contaminated: a hit word, and at least one word in twenty hit."""
    return judged.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", "items"), 256),
            "contaminated": F.expr("n_hit > 0 and 20 * n_hit >= n_words"),
        }
    )
