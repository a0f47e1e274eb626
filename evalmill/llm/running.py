"""Running sums and places within groups of any size, without a group in one task.

Rows are dealt into ranges of group and order, so that a large group spreads over many tasks.  Each task adds up its own
rows; what the last rows of a task hand on to the next one are two rows a task, and one row a task comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import Scratch, column, longs, starts_of, tidied

_MARKS = ("_task", "_edge")


def _accumulated(group: str, kept: list[str], adds: list[str], xors: list[str]):
    """Running values inside a task, with ``_edge`` rows that give the totals of its first and its last group."""
    values = ["place", *adds, *xors]

    def joined(x: np.ndarray, y: np.ndarray, name: str) -> np.ndarray:
        return x ^ y if name in xors else x + y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at, last, first = None, np.zeros(len(values), np.int64), None  # the group at the end so far, its values; totals of the first one
        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            g = column(batch, group)
            starts = starts_of(g)
            length = np.diff(np.append(starts, len(g)))
            if at is not None and g[0] != at:
                first = first or (at, last)
                last = np.zeros(len(values), np.int64)
            goes_on = np.arange(len(g)) < length[0]
            out = []
            for i, name in enumerate(values):
                x = np.ones(len(g), np.int64) if name == "place" else column(batch, name)
                acc = (np.bitwise_xor if name in xors else np.add).accumulate(x)
                before = np.where(starts > 0, acc[starts - 1], 0)
                acc = joined(acc, np.repeat(before if name in xors else -before, length), name)
                out.append(np.where(goes_on, joined(acc, last[i], name), acc))
            if first is None and len(starts) > 1:
                first = (int(g[0]), np.array([x[starts[1] - 1] for x in out]))
            at, last = int(g[-1]), np.array([x[-1] for x in out])
            marks = [longs(np.full(len(g), task)), pa.array(np.zeros(len(g), bool))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in [group, *kept]] + [*map(longs, out), *marks], [group, *kept, *values, *_MARKS])
        if at is None:
            return
        ends = [first, (at, last)] if first else [(at, last)]
        none = [pa.nulls(len(ends), schema.field(c).type) for c in kept]
        totals = [longs([e[1][i] for e in ends]) for i in range(len(values))]
        marks = [longs([task] * len(ends)), pa.array([True] * len(ends))]
        yield pa.RecordBatch.from_arrays([longs([e[0] for e in ends]), *none, *totals, *marks], [group, *kept, *values, *_MARKS])

    return run


def running(rows: DataFrame, group: str, order: list[str], scratch: Scratch, adds: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``place`` (from 1) and with running sums in the columns ``adds`` and running exclusive ors in ``xors``, in
    the order of ``order`` within each group.  group, adds and xors are longs without nulls; other columns go along.

    Rows equal in ``order`` come in any order, and may be dealt to several tasks.
    """
    kept = [c for c in rows.columns if c not in (group, "place", *adds, *xors)]
    values = ["place", *adds, *xors]
    fields = [T.StructField(group, T.LongType()), *(rows.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in [*values, "_task"])]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in fields), T.StructField("_edge", T.BooleanType())])
    line = [group, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*line).sortWithinPartitions(*line).drop("_tie")
    done = scratch.save(dealt.mapInArrow(tidied(_accumulated(group, kept, list(adds), list(xors))), schema))
    carried: list[tuple] = []
    so_far: dict[int, list[int]] = {}
    # at most two rows a task come here: what its first and its last group amount to
    for r in done.where("_edge").select("_task", group, *values).orderBy("_task", group).collect():
        old = so_far.get(r[group])
        if old is not None:
            carried.append((r["_task"], r[group], *old))
        so_far = {r[group]: [r[c] if old is None else r[c] ^ old[i] if c in xors else r[c] + old[i] for i, c in enumerate(values)]}
    rows_ = done.where("not _edge")
    if not carried:
        return rows_.drop(*_MARKS)
    names = [f"_c_{c}" for c in values]
    carry = rows.sparkSession.createDataFrame(carried, ", ".join(f"{c} long" for c in ["_task", "_group", *names]))
    rows_ = rows_.join(F.broadcast(carry), (done["_task"] == carry["_task"]) & (F.col(group) == F.col("_group")), "left")
    for c in values:
        more = F.coalesce(F.col(f"_c_{c}"), F.lit(0))
        rows_ = rows_.withColumn(c, F.col(c).bitwiseXOR(more) if c in xors else F.col(c) + more)
    return rows_.select(group, *kept, *values)
