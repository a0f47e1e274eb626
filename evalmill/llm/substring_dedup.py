"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``window - k + 1`` neighbouring k-grams the one with the smallest hash, so
each window of ``window`` words has exactly one anchor of its own, the same in every document.  Anchors that two
documents share are the seeds; from a seed the match is extended both ways as far as the windows it anchors go, by
comparing the windows themselves (96 bits of hash).  Overlapping repeated windows join into maximal repeats.

Nothing is done per pair.  A worker sorts the anchors of the documents it has read: documents that share an anchor
there know it at once and send one row on for all of them, so a passage in a third of all documents costs one row a
block, not one a document.  The same holds for the windows, where only the smallest document of a block goes on.

A word goes when a window over it also begins in a document with a smaller id; all windows are judged on the input.
Null and empty texts have no words.  A document with a null id is neither judged nor a reason to remove words.
Rows that repeat an id are judged each by its own text, and do not count as smaller than each other, whether their texts
agree or not; windows of all of them count for larger ids.  Where an id has several texts, documents go by a key of the id
and, in its last bits, the number of the text.  A text of any length is hashed in blocks of 1 MB; its words are a list when
they are put together again.  An empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Buffer, Scratch, batch_of, column, longs, prepared, saved, sieved, starts_of, texts, tidied
from .running import running
from .words import PLAIN, Rule, blocks, kgrams, texts_of, winnow

WINDOW, K = 13, 7
ROWS = 1_000_000  # anchors or windows that a worker sorts at once
OUT_ROWS = 100_000


def _cut(names: list[str], arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(arrays[0]), OUT_ROWS):
        yield batch_of(names, [a[i : i + OUT_ROWS] for a in arrays])


def _anchors(rule: Rule, window: int, k: int):
    names = ["hash", "doc", "known"]

    def flush(buffer: Buffer) -> Iterator[pa.RecordBatch]:
        h, d = buffer.take()
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        start = starts_of(h)
        shared = np.add.reduceat(np.append(d[1:] != d[:-1], False) & np.append(h[1:] == h[:-1], False), start) > 0 if len(h) else start
        yield from _cut(names, [h[start], d[start], np.zeros(len(start), bool)])
        mine = np.repeat(shared, np.diff(np.append(start, len(h))))
        yield from _cut(names, [h[mine], d[mine], np.ones(int(mine.sum()), bool)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(2, ROWS)
        for batch in batches:
            ids = column(batch, "key")
            for block in blocks(batch.column("text"), rule):
                grams = kgrams(block.hashes, k)
                at = winnow(grams, block.inside(k), window - k + 1)
                at = np.unique(at[at >= 0])
                if buffer.add(grams[at].view(np.int64), ids[block.rows][block.owner()[at]]):
                    yield from flush(buffer)
        yield from flush(buffer)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash: those whose hash several documents have."""
    h, d = np.empty(0, np.int64), np.empty(0, np.int64)

    def done(h: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(h):
            start = starts_of(h)
            many = np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start)
            rows = np.repeat(many, np.diff(np.append(start, len(h))))
            yield from _cut(["doc", "hash"], [d[rows], h[rows]])

    for batch in batches:
        known = batch.column("known").to_numpy(zero_copy_only=False)
        bh, bd = column(batch, "hash"), column(batch, "doc")
        yield from _cut(["doc", "hash"], [bd[known], bh[known]])
        h, d = np.concatenate([h, bh[~known]]), np.concatenate([d, bd[~known]])
        if len(h):
            last = int(np.searchsorted(h, h[-1], "left"))  # the last hash may go on in the next batch
            yield from done(h[:last], d[:last])
            h, d = h[last:], d[last:]
    yield from done(h, d)


LOW = (1 << 32) - 1


def _windows(rule: Rule, window: int, k: int, shift: int):
    """Windows whose anchor is shared: hash, and 32 more bits of hash beside the first word.

    Those that a smaller document of the same block has are known to go; they are sent as runs, with the length of the
    run in place of the further bits.
    """
    names = ["hash", "at", "doc", "known", "more"]

    def flush(buffer: Buffer) -> Iterator[pa.RecordBatch]:
        h, at, d = buffer.take()
        order = np.lexsort((d, at >> 32, h))
        h, at, d = h[order], at[order], d[order]
        start = starts_of(h, at >> 32)
        known = d >> shift > np.repeat(d[start] >> shift, np.diff(np.append(start, len(d))))
        # a document that holds a window many times sends one row, with its further places
        ah, aa, ad = h[~known], at[~known], d[~known]
        first = starts_of(ah, aa >> 32, ad)
        times = np.diff(np.append(first, len(ah)))
        rest = np.ones(len(ah), bool)
        rest[first] = False
        places, ends = aa[rest] & LOW, np.concatenate([[0], np.cumsum(times - 1)])
        for i in range(0, len(first), OUT_ROWS):
            j = min(i + OUT_ROWS, len(first))
            some = first[i:j]
            more = pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - ends[i], pa.int32()), pa.array(places[ends[i] : ends[j]]))
            yield pa.RecordBatch.from_arrays([longs(ah[some]), longs(aa[some]), longs(ad[some]), pa.array(np.zeros(j - i, bool)), more], names)
        d, at = d[known], at[known] & LOW
        order = np.lexsort((at, d))
        d, at = d[order], at[order]
        start = starts_of(d, at - np.arange(len(at)))
        runs = np.diff(np.append(start, len(at)))
        for cut in _cut(names[:4], [d[start], runs << 32 | at[start], d[start], np.ones(len(start), bool)]):
            yield cut.append_column("more", pa.nulls(cut.num_rows, pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(3, ROWS)
        for batch in batches:
            batch = batch.filter(batch.column("seeds").is_valid())
            ids, seeds = column(batch, "key"), batch.column("seeds")
            for block in blocks(batch.column("text"), rule):
                h = block.hashes
                grams = kgrams(h, k)
                own = winnow(grams, block.inside(k), window - k + 1)
                at = np.flatnonzero(own >= 0)
                owner = block.owner()
                keep = []
                for i, places in enumerate(np.split(at, np.searchsorted(at, block.first[1:-1]))):
                    mine = seeds[block.rows.start + i].values.to_numpy(zero_copy_only=False)
                    keep.append(places[np.isin(grams[own[places]].view(np.int64), mine)])
                at = np.concatenate(keep)
                full = kgrams(h, window)[at].view(np.int64)
                more = kgrams(h, window, second=True)[at] & ~np.uint64(LOW)
                place = (at - block.first[owner[at]]).astype(np.uint64)
                if buffer.add(full, (more | place).view(np.int64), ids[block.rows][owner[at]]):
                    yield from flush(buffer)
        yield from flush(buffer)

    return run


def _repeated(shift: int):
    """Rows sorted by window and document: runs of windows that are not of the window's smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            h, at, d = (column(batch, c) for c in ("hash", "at", "doc"))
            yield from _cut(["doc", "run"], [d[known], at[known]])
            more = batch.column("more").filter(pa.array(~known))
            h, at, d = h[~known], at[~known], d[~known]
            if len(h):
                start = starts_of(h, at >> 32)
                least = d[start]
                if last is not None and (h[0], at[0] >> 32) == last[:2]:
                    least[0] = last[2]
                gone = d >> shift > np.repeat(least >> shift, np.diff(np.append(start, len(d))))
                last = (int(h[-1]), int(at[-1] >> 32), int(least[-1]))
                yield from _cut(["doc", "run"], [d[gone], 1 << 32 | at[gone] & LOW])
                also = more.filter(pa.array(gone))
                places = also.flatten().to_numpy(zero_copy_only=False)
                if len(places):
                    times = np.diff(also.offsets.to_numpy())
                    yield from _cut(["doc", "run"], [np.repeat(d[gone], times), 1 << 32 | places])

    return run


def _staying(runs: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words no window of the runs covers."""
    edge = np.zeros(n + 1, np.int64)
    start = runs & LOW
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (runs >> 32) - 1 + window, -1)
    return np.cumsum(edge[:-1]) == 0


def _keep(rule: Rule, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: list[int] = []
            removed: list[int] = []
            kept: list[bytes] = []
            for text, places in zip(texts_of(batch.column("text")), batch.column("runs"), strict=True):
                words = text.as_py().translate(rule.table).split()
                gone = 0
                sizes.append(len(words))
                if places.is_valid and len(places.values):
                    stay = _staying(places.values.to_numpy(zero_copy_only=False), window, len(words))
                    gone = len(words) - int(stay.sum())
                    words = [w for w, x in zip(words, stay.tolist(), strict=True) if x]
                removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    longs(sizes),
                    longs(removed),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, k: int = K, rule: Rule = PLAIN, shift: int = 0) -> DataFrame:
    """doc, runs: windows that a document with a smaller id has too, as length << 32 | first word; docs: key, text.

    The id is what stands above the last ``shift`` bits of the key.  Texts are dealt out by key once: this join and the one
    of ``dedup_substrings`` have the same left side, which is why it keeps all rows here and rows without seeds are left
    out by the worker.
    """
    prepared(docs.sparkSession)
    spread = F.when(F.col("known"), F.xxhash64("doc", "hash")).otherwise(F.col("hash"))
    seeds = (
        docs.where("key is not null")
        .mapInArrow(tidied(_anchors(rule, window, k)), "hash long, doc long, known boolean")
        .repartition(spread)
        .sortWithinPartitions("hash")
        .mapInArrow(tidied(_shared), "doc long, hash long")
        .groupBy("doc")
        .agg(F.collect_list("hash").alias("seeds"))
    )
    spread = F.when(F.col("known"), F.xxhash64("doc", "at")).otherwise(F.col("hash"))
    return (
        docs.join(seeds, docs["key"] == seeds["doc"], "left")
        .select("key", "text", "seeds")
        .mapInArrow(tidied(_windows(rule, window, k, shift)), "hash long, at long, doc long, known boolean, more array<long>")
        .repartition(spread)
        .sortWithinPartitions("hash", F.shiftright("at", 32), "doc")
        .mapInArrow(tidied(_repeated(shift)), "doc long, run long")
        .groupBy("doc")
        .agg(F.collect_list("run").alias("runs"))
    )


def keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, DataFrame | None]:
    """key and text of every row; the bits by which a key is longer than an id; and the ids (of) by their places (at) where
    keys are made of places.  A null id has a null key.

    Without an id of several texts the key is the id.  Else each text of such an id has a number, given by ranges of hashes
    so that an id of very many texts does not meet in one task; ids that leave too few bits go by their place among all.
    """
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("least"), F.max(h).alias("most")).where("least < most")
    several = scratch.save(several.select(F.col("doc_id").alias("of")))
    if several.isEmpty():
        return docs.select(F.col("doc_id").alias("key"), "text"), 0, None
    some, rest = sieved(docs, "doc_id", several)
    lines = some.select(F.col("doc_id").alias("of"), h.alias("h")).join(several, "of", "left_semi").distinct()
    numbers = running(lines, "of", ["h"], scratch)
    shift = (numbers.agg(F.max("place")).first()[0] - 1).bit_length()
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    numbers = numbers.withColumnRenamed("h", "h_of")
    some = some.withColumn("h", h).join(numbers, F.expr("doc_id = of and h = h_of"), "left")
    some = some.select("doc_id", "text", F.coalesce(F.col("place") - 1, F.lit(0)).alias("number"))
    every = rest.withColumn("number", F.lit(0).cast("long")).unionByName(some)
    at, places = F.col("doc_id"), None
    if max(high, -low - 1) >> (63 - shift):
        ids = docs.where("doc_id is not null").select("doc_id", F.lit(0).cast("long").alias("all")).distinct()
        places = saved(running(ids, "all", ["doc_id"], scratch).select(F.col("doc_id").alias("of"), F.col("place").alias("at")))
        every, at = every.join(places, F.col("doc_id") == F.col("of"), "left"), F.col("at")
    return saved(every.select(F.shiftleft(at, shift).bitwiseOR(F.col("number")).alias("key"), "text")), shift, places


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, rule: Rule = PLAIN
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space) of every row."""
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and window")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    prepared(docs.sparkSession)
    with Scratch(docs.sparkSession, "repeats") as scratch:
        docs, shift, places = keyed(texts(docs, id_col, text_col), scratch)
    found = repeated_windows(docs, window, k, rule, shift)
    # the same two columns as in the join for windows, so that texts are dealt out once for both
    rows = docs.join(found, docs["key"] == found["doc"], "left").select(F.col("key").alias("doc_id"), "text", "runs")
    out = rows.mapInArrow(tidied(_keep(rule, window)), schema)
    if not shift:
        return out
    out = out.withColumn("doc_id", F.shiftright("doc_id", shift))
    if places is not None:
        out = out.join(places, F.col("doc_id") == F.col("at"), "left").withColumn("doc_id", F.col("of")).drop("of", "at")
    return out
