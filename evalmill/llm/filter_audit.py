"""What each of several filters removes, in every order in which they may run: a Walsh-Hadamard audit.

1. ``failing`` judges every whole text by four conditions, and every document by whether a smaller id has the same text:
   a mask with a bit for each filter that the document fails.
2. ``audit`` adds up, for each part and label, the masks' 2^n signed parity sums (+1 where the mask has an even number of
   the bits of s, -1 where an odd one; 32 sums for five filters).  These are all that leaves the workers.
3. The transform is its own inverse but for the factor 2^n, so whole-number division gives the count of each mask exactly.
4. Every order and step is evaluated on those counts: what a filter removes are the masks with its bit and none of the
   bits of the filters before it.  Over all n! orders a document with k failures falls to each of these n!/k times, which
   gives the Shapley sums without a look at the orders.

Null texts count as empty, a null part as the empty string.  Rows are documents each, also where an id comes again; rows of
one id with one text are no copies of each other.  A null id has no order, so that it neither is nor has a copy, and has
no label.  Labels that come again hold when any row says so; null is no label.  A document without one counts without.  An
empty table gives an empty result.  Texts of any length go through in blocks of 1 MB; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, longs, prepared, saved, starts_of, tidied
from .words import BLOCK_BYTES, PLAIN, blocks, texts_of

NAMES = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, b"#$%&*|"
MOST_FILTERS = 8  # 2^8 sums a group, 8! orders


def _table(inside: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


_CAPITALS, _MARKS = _table(bytes(range(65, 91))), _table(MARKS)
_POINTS = np.arange(256) & 0xC0 != 0x80  # the first byte of each code point


def _per_text(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bytes of each text that the table names; at: where the texts begin, and the end."""
    out = np.zeros(len(at) - 1, np.int64)
    for i in range(0, len(raw), BLOCK_BYTES):
        sums = np.concatenate([[0], np.cumsum(table[raw[i : i + BLOCK_BYTES]])])
        cut = sums[np.clip(at - i, 0, len(sums) - 1)]
        out += cut[1:] - cut[:-1]
    return out


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = texts_of(batch.column("text"))
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        mask = np.zeros(len(column), np.int64)
        for block in blocks(column, PLAIN):
            n, owner = block.sizes, block.owner()
            order = np.lexsort((block.hashes, owner))
            new = starts_of(owner[order], block.hashes[order])
            distinct = np.bincount(owner[order][new], minlength=len(n))
            at = offsets[block.rows.start : block.rows.stop + 1]
            raw, at = data[at[0] : at[-1]], at - at[0]
            fails = (
                n < LEAST_WORDS,
                100 * distinct < DISTINCT_PERCENT * n,
                100 * _per_text(raw, at, _CAPITALS) > CAPITAL_PERCENT * _per_text(raw, at, _POINTS),
                _per_text(raw, at, _MARKS) > 0,
            )
            mask[block.rows] = sum(f.astype(np.int64) << i for i, f in enumerate(fails))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "digest")] + [longs(mask)], ["doc_id", "part", "digest", "mask"])


def failing(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, good, toxic, mask, n: n documents that fail the filters of the mask (A is the lowest bit).

    Two documents are copies when the MD5 of their texts agree.  Equal rows meet as counts, and only the first of each text
    is joined back, by id and text, so that a text that very many documents share makes no large group.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"),
        "text",
    )
    prepared(docs.sparkSession)
    rows = own.mapInArrow(tidied(_masked), "doc_id long, part string, digest binary, mask long")
    rows = scratch.save(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    unnamed = rows.where("doc_id is null").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", "n")
    rows = rows.where("doc_id is not null")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = scratch.save(flags.agg(says("quality").alias("good"), says("toxic").alias("toxic")).where("good or toxic"))
    copy = F.when(F.col("first"), 0).otherwise(1 << NAMES.index("E"))
    named = rows.join(scratch.save(firsts), ["doc_id", "digest"], "left").join(flags, "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return named.select("part", flag("good"), flag("toxic"), F.col("mask").bitwiseOR(copy).alias("mask"), "n").unionByName(unnamed)


def parity(masks: DataFrame, by: list[str], n_filters: int) -> DataFrame:
    """For each group the 2^n signed parity sums of its masks, as an array ``sums``."""
    odd = lambda s: F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2
    signed = [F.sum(F.col("n") * (1 - 2 * odd(s))).alias(f"_w{s}") for s in range(1 << n_filters)]
    return masks.groupBy(*by).agg(*signed).select(*by, F.array(*(f"_w{s}" for s in range(1 << n_filters))).alias("sums"))


def inverted(sums: str, n_filters: int) -> Column:
    """The counts of all masks from their signed parity sums, exactly."""
    signed = f"transform({sums}, (x, s) -> if(bit_count(m & s) % 2 = 0, x, -x))"
    return F.expr(f"transform(sequence(0, {(1 << n_filters) - 1}), m -> aggregate({signed}, 0L, (a, x) -> a + x) div {1 << n_filters}L)")


def audit(masks: DataFrame, names: str = NAMES, part: str = "part", labels: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """A row for each part, order and step: filter_order, step, filter, and the part's counts kept, removed, redundant,
    unique_fails, <label>_lost for each label, and shapley.

    masks: the part, the labels (true or false), mask, and n.  names: a character for each filter, from the lowest bit on.
    """
    if not 0 < len(set(names)) == len(names) <= MOST_FILTERS or "," in names:
        raise ValueError(f"filters have names of one character each, and there are {MOST_FILTERS} at most")
    n = len(names)
    cells = parity(masks, [part, *labels], n).withColumn("_cells", inverted("sums", n)).drop("sums")
    orders = ",".join(sorted("".join(p) for p in permutations(names)))
    bit = lambda letter: f"shiftleft(1, instr('{names}', {letter}) - 1)"
    steps = cells.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("_bit", F.expr(bit("filter")))
    earlier = f"aggregate(filter(split(filter_order, ''), (c, i) -> i < step - 1), 0, (a, c) -> a | {bit('c')})"
    steps = steps.withColumn("_before", F.expr(earlier))

    def total(value: str) -> Column:
        return F.expr(f"aggregate(transform(_cells, (x, m) -> {value}), 0L, (a, x) -> a + x)")

    fails = "m & _bit != 0"
    counts = {
        "kept": total("if(m & (_before | _bit) = 0, x, 0L)"),
        "removed": total(f"if({fails} and m & _before = 0, x, 0L)"),
        "redundant": total(f"if({fails} and m & _before != 0, x, 0L)"),
        "unique_fails": total("if(m = _bit, x, 0L)"),
        "shapley": total(f"if({fails}, x * ({factorial(n)} div bit_count(m)), 0L)"),
    }
    steps = steps.select(part, *labels, "filter_order", "step", "filter", *(c.alias(f"_{k}") for k, c in counts.items()))
    lost = [F.sum(F.when(F.col(c), F.col("_removed")).otherwise(0)).alias(f"{c}_lost") for c in labels]
    return steps.groupBy(part, "filter_order", "step", "filter").agg(*(F.sum(f"_{k}").alias(k) for k in counts), *lost)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents, by ``lang``; labels: doc_id, quality and toxic (0 or 1)."""
    with Scratch(prepared(docs.sparkSession), "audit") as scratch:
        return saved(audit(failing(docs, labels, scratch)))
