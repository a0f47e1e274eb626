"""A language model of character n-grams, and drift by any model: how much of a text is written in another language.

The model's counts come from one grouped aggregation over labelled texts, whose rows are (label, bucket, n): at most
BUCKETS rows a label, each worker adding up its own first.  Drift is one pass over the texts without a shuffle.  A judge is
any function of a list of lines that gives their labels and how sure it is, so another model can stand in for this one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.functions import points as pt
from evalmill.functions import profiles as pf

Judge = Callable[[list[str]], tuple[list[str], np.ndarray]]
_MARKUP = re.compile(pf.MARKUP.replace(r"\p{Nd}", r"\d"))


def bare(line: str) -> str:
    """A line without markup and digits, single spaces."""
    return " ".join(_MARKUP.sub(" ", line).split())


BUCKETS, ORDERS, MOST_LABELS = 1 << 15, (1, 2, 3), 256


def _buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams, and the text of each, chunk by chunk."""
    for part in pt.chunks(texts):
        cps, first = pt.points([f" {t.lower()} " for t in texts[part]])
        for n in ORDERS:
            h, owner = pt.grams(cps, first, n)
            yield (h >> np.uint64(17)) % np.uint64(BUCKETS), owner + part.start


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for label, counts in held.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some)), pa.array(some), pa.array(counts[some])], ["label", "bucket", "n"])
        held.clear()

    for batch in batches:
        frame = batch.to_pandas()
        for label, texts in frame.groupby("label")["text"]:
            if label not in held and len(held) >= MOST_LABELS:
                yield from give()
            counts = held.setdefault(label, np.zeros(BUCKETS, np.int64))
            for buckets, _ in _buckets([bare(t) for t in texts]):
                counts += np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
    yield from give()


def train(texts: DataFrame) -> DataFrame:
    """label, bucket, n of labelled texts (label, text), without markup and digits; rows with a null teach nothing."""
    known = texts.where("label is not null and text is not null").select("label", "text")
    return known.mapInArrow(_counted, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def judge_of(model: DataFrame) -> Judge:
    """The most probable label of a line, all labels being alike before it is read, and its probability after.

    Every worker gets the model: labels x BUCKETS numbers of 4 bytes, 128 KB a label; more than MOST_LABELS are an error.
    N-grams of several lengths tell the same letters, so their evidence counts as often as there are letters.
    """
    model = model.persist(StorageLevel.MEMORY_AND_DISK)
    labels = sorted(r[0] for r in model.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if not 0 < len(labels) <= MOST_LABELS:
        model.unpersist()
        raise ValueError(f"a model needs 1 to {MOST_LABELS} labels")
    rows = model.toArrow()  # no more than MOST_LABELS * BUCKETS
    model.unpersist()
    counts = np.zeros((BUCKETS, len(labels)), np.float64)
    at = {label: i for i, label in enumerate(labels)}
    counts[rows.column("bucket").to_numpy(), [at[x] for x in rows.column("label").to_pylist()]] = rows.column("n").to_numpy()
    # a bucket that a label never had counts like its share of all labels
    share = (counts.sum(axis=1, keepdims=True) + 1) / (counts.sum() + BUCKETS)
    table = model.sparkSession.sparkContext.broadcast(np.log((counts + share * 1000) / (counts.sum(axis=0) + 1000)).astype(np.float32))

    def judge(lines: list[str]) -> tuple[list[str], np.ndarray]:
        score = np.zeros((len(lines), len(labels)))
        for buckets, owner in _buckets(lines):
            if len(owner):
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                score[owner[starts]] += np.add.reduceat(table.value[buckets.astype(np.int64)], starts, axis=0)
        score /= len(ORDERS)
        score = np.exp(score - score.max(axis=1, keepdims=True, initial=-np.inf))
        best = score.argmax(axis=1)
        return [labels[i] for i in best], score[np.arange(len(lines)), best] / score.sum(axis=1)

    return judge


def drift(docs: DataFrame, key: str, text: str, expected: str, judge: Judge) -> DataFrame:
    """key and drift of every row: of the letters in lines that ``judge`` is sure about, the share in lines of another
    language than ``expected`` (a label); null where there is no such line or no label.

    Texts go through NFC; lines lose markup and digits, and count from 30 letters on; blank ones aside, a text without line
    ends is one line.
    """

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = pt.classes(pf.SCRIPTS)[0] > 0
        for frame in frames:
            lines, rows = [], []
            for i, (t, label) in enumerate(zip(frame["_text"], frame["_label"], strict=True)):
                if t and isinstance(label, str):
                    own = [bare(x) for x in unicodedata.normalize("NFC", t).splitlines()]
                    own = [x for x in own if len(x) >= pf.MIN_LETTERS]
                    lines += own
                    rows += [i] * len(own)
            weight = np.zeros(len(lines), np.int64)
            for part in pt.chunks(lines):
                cps, first = pt.points(lines[part])
                sums = np.concatenate([[0], np.cumsum(letters[cps])])
                weight[part] = sums[first[1:]] - sums[first[:-1]]
            some = np.flatnonzero(weight >= pf.MIN_LETTERS)
            labels, sure = judge([lines[i] for i in some]) if len(some) else ([], np.empty(0))
            some, labels = some[sure >= pf.MIN_CONFIDENCE], [x for x, s in zip(labels, sure, strict=True) if s >= pf.MIN_CONFIDENCE]
            own = np.array(rows, np.int64)[some]
            wrong = np.array(labels, object) != frame["_label"].to_numpy(object)[own]
            total = np.bincount(own, weights=weight[some], minlength=len(frame))
            away = np.bincount(own[wrong], weights=weight[some][wrong], minlength=len(frame))
            share = pd.arrays.FloatingArray(away / np.maximum(total, 1), total == 0)
            yield pd.DataFrame({key: frame[key], "drift": share})

    rows = docs.select(key, F.col(text).alias("_text"), F.col(expected).alias("_label"))
    return rows.mapInPandas(measured, T.StructType([docs.schema[key], T.StructField("drift", T.DoubleType())]))
