"""Quality rules: base rules on whole texts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` buckets.  Two multinomials are counted over all documents: the raw
corpus, and its trusted part (documents with a good label; ids of at most ``trusted_rows`` of them, in the order of a
hash, are sent to the workers).  A document's score is the mean over its n-grams of log(trusted / raw); every document
is held against the same threshold, so the result is deterministic.  Ratios are rounded to multiples of 2**-20 and
summed as integers: the score does not depend on the order of work.

Null and empty texts fail the base rules.  Without trusted documents all ratios are 0 and only base rules decide.  A score
equal to the threshold passes.  Each row counts and is judged by itself; an id with several rows is trusted in all of
them.  Columns of ``docs`` with the names of new ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import annotate, longs, prepared, tidied
from .words import PLAIN, SPACES, LOWER, Block, blocks, cover, kgrams, mix, ranges, texts_of

BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
THRESHOLD = -0.5
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SCALE = 1 << 20
FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def _features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words and of word pairs, with the document of each."""
    owner = block.owner()
    yield (kgrams(block.hashes, 1) % np.uint64(BUCKETS)).astype(np.int64), owner
    inside = block.inside(2)
    yield (kgrams(block.hashes, 2)[inside] % np.uint64(BUCKETS)).astype(np.int64), owner[: len(inside)][inside]


def repeated_words(block: Block, k: int = 3) -> np.ndarray:
    """Of each document: words in windows of k words that the document has twice or more."""
    inside = np.flatnonzero(block.inside(k))
    owner = block.owner()
    grams = kgrams(block.hashes, k)[inside] ^ mix(owner[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    again = np.zeros(len(grams), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    hit = cover(inside[again], k, int(block.first[-1]))
    return np.bincount(owner[hit], minlength=len(block.sizes))


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, trusted_rows: int) -> np.ndarray:
    """log(trusted / raw) of each bucket, times SCALE, as integers; both multinomials smoothed by one count."""
    spark = docs.sparkSession
    ids = [
        r[0]
        for r in labels.where("doc_id is not null and quality = 1")
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(trusted_rows)
        .collect()
    ]
    trusted = spark.sparkContext.broadcast(np.sort(np.asarray(ids, np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            own = np.isin(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), trusted.value)
            own &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text"), LOWER):
                for bucket, owner in _features(block):
                    raw += np.bincount(bucket, minlength=BUCKETS)
                    good += np.bincount(bucket[own[block.rows][owner]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([longs(at), longs(raw[at]), longs(good[at])], ["bucket", "raw", "good"])

    counted = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(tidied(count), "bucket long, raw long, good long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .collect()  # at most BUCKETS rows
    )
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counted:
        raw[r.bucket] += r.raw
        good[r.bucket] += r.good
    if good.sum() == BUCKETS:
        return np.zeros(BUCKETS, np.int64)
    return np.rint((np.log(good / good.sum()) - np.log(raw / raw.sum())) * SCALE).astype(np.int64)


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trusted_rows: int = TRUSTED_ROWS,
    threshold: float = THRESHOLD,
    need: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the base figures, base_failed, score and kept; labels: doc_id, quality (1 is trusted)."""
    spark = prepared(docs.sparkSession)
    table = spark.sparkContext.broadcast(ratios(docs, labels, id_col, text_col, trusted_rows))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        body = texts_of(batch.column(text_col))
        plain = list(blocks(body, PLAIN))
        n_words = np.concatenate([b.sizes for b in plain])
        sums = [np.concatenate([[0], np.cumsum(b.chars)]) for b in plain]
        chars = np.concatenate([s[b.first[1:]] - s[b.first[:-1]] for s, b in zip(sums, plain, strict=True)])
        repeats = np.concatenate([repeated_words(b) for b in plain])
        symbols, lines = [], []
        for start, stop in ranges(body):
            for text in body.slice(start, stop - start).to_pylist():
                symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
                lines.append(_dup_lines(text))
        failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
        scores = []
        for block in blocks(body, LOWER):
            total, n = np.zeros(len(block.sizes), np.int64), np.zeros(len(block.sizes), np.int64)
            for bucket, owner in _features(block):
                np.add.at(total, owner, table.value[bucket])
                n += np.bincount(owner, minlength=len(n))
            scores.append(total / np.maximum(n, 1) / SCALE)
        score = np.concatenate(scores)
        return [
            longs(n_words), longs(chars), longs(symbols), longs(lines), longs(repeats),
            pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold)),
        ]

    return annotate(docs, FIELDS, make, need)
