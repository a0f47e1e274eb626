"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on full sets.

A document is the set of its ``K``-word shingles; two documents link when 100 * |A & B| >= ``PERCENT`` * |A | B|, and a group
is what links connect.

1. Equal sets collapse into one (128 bits of hash), so copies cost nothing further.
2. Each set gets ``BANDS`` * ``ROWS`` MinHash samples.  The samples of a band make its key; the parities of all samples,
   hashed to ``BITS`` bits, make the odd sketch: a bit is on when an odd number of samples falls on it.
3. Sets that have a band in common make lists, and a list that comes from several bands is kept once.  In a list the
   population count of the exclusive or of two sketches tells in how many samples two sets differ: z odd bits come from at
   least z samples, two for each difference.  Pairs with more than ``LIMIT`` odd bits are dropped; the rest connects the
   list.  A list too long for one matrix is first cut by what pairs cannot have: sizes too far apart, and distances to a
   pivot too far apart (odd bits are a metric).
4. Sets that remain connected share a block.  Blocks are dealt into parts by size and hash, parts that can link meet, and
   there sketches choose the pairs again, which are then confirmed on the full sets.  Pairs that confirmed links connect
   already need no look of their own.
5. Components of the confirmed links.

A link is missed only when no band agrees, or when a pair at the threshold differs in more samples than its sketches may
show.  For a similarity s the first has a chance of (1 - s^ROWS)^BANDS, 7e-11 at 0.85 and less above; the second 1e-10 (see
``least_limit``).  A pair that some chain of links connects is in one group also then.  No pair is linked wrongly.

Null, empty and blank texts have no shingles and link with nothing.  Fewer than K words make one shingle.  Rows with one id
count as one document: links of any of its texts are its own.  A null id gets its n_shingles and a null component.  Texts of
any length are cut into blocks of 1 MB.  Further columns play no part.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, Seen, batch_of, column, longs, prepared, saved, sieved, starts_of, texts, tidied
from .jaccard_join import _UNIT, Sets, _labels, _overlaps, _units, components
from .words import LOWER, Rule, blocks, mix

K, PERCENT = 3, 85
BANDS, ROWS, BITS = 40, 5, 1024
MATRIX = 1024  # sets of a list that are compared with each other at once
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FOLD = np.uint64(0xFF51AFD7ED558CCD)


def least_limit(percent: int, samples: int, chance: float = 1e-10) -> int:
    """Odd bits that a pair at the threshold exceeds with less than ``chance``: twice the differing samples, whose number
    is binomial; where samples fall on one bit there are fewer odd ones, never more."""
    p, d = 1 - percent / 100, 0
    while d < samples and sum(comb(samples, x) * p**x * (1 - p) ** (samples - x) for x in range(d + 1, samples + 1)) >= chance:
        d += 1
    return 2 * d


# ---------------------------------------------------------------- sketches


def samples_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash samples (a row each) of non-empty sets that stand one after another from ``first`` on."""
    out = np.empty((len(_SEEDS), len(first)), np.uint64)
    if len(first):
        spread = mix(values ^ _FOLD)
        held = np.empty_like(spread)
        for i, seed in enumerate(_SEEDS):
            np.multiply(spread, seed, out=held)
            np.minimum.reduceat(held, first, out=out[i])
    return out


def folded(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each band, and the odd sketch as words of 64 bits, a row for each set."""
    n = samples.shape[1]
    told = mix(samples ^ _SEEDS[:, None])  # a sample counts with its place
    bands = mix(told.reshape(BANDS, ROWS, n).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None]).T
    bits = np.zeros((n, BITS), np.uint8)
    for row in told:
        bits[np.arange(n), (row & np.uint64(BITS - 1)).astype(np.int64)] ^= 1
    return bands, np.packbits(bits, axis=1, bitorder="little").view("<u8")


def odd_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of ``a`` (rows) and ``b`` (columns) differ."""
    out = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _sketched(rule: Rule, k: int):
    """A row for each document, with bands and sketch where the worker meets its set for the first time."""
    names = ["doc_id", "n", "h1", "h2", "bands", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            ids = batch.column("doc_id")
            real = ids.is_valid().to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text"), rule):
                sets = Sets(block, k)
                h1, h2 = sets.keys()
                some = np.flatnonzero(real[block.rows] & (sets.n > 0))
                fresh = np.zeros(len(h1), bool)
                fresh[some] = seen.fresh(h1[some])
                take = fresh[sets.own]
                n = sets.n[fresh]
                bands, sketch = folded(samples_of(sets.value[take], np.cumsum(n) - n))
                data = [[None] * len(h1), [None] * len(h1)]
                for i, at in enumerate(np.flatnonzero(fresh).tolist()):
                    data[0][at], data[1][at] = bands[i].tobytes(), sketch[i].tobytes()
                arrays = [ids[block.rows], longs(sets.n), longs(h1), longs(h2), *(pa.array(x, pa.binary()) for x in data)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


# ---------------------------------------------------------------- lists


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, h1 for each band of each set."""
    for batch in batches:
        if batch.num_rows:
            bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield batch_of(["band", "h1"], [bands, np.repeat(column(batch, "h1"), BANDS)])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by band and set: the sets of each band that has several, under a hash of all of them.

    Only hashes are held, and a list that is longer than a batch goes on with the next one.
    """

    def work(t: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        new = starts_of(t, s)
        t, s = t[new], s[new]
        start = starts_of(t)
        length = np.diff(np.append(start, len(t)))
        key = mix(np.add.reduceat(mix(s.view(np.uint64)), start) + length.astype(np.uint64)).view(np.int64)
        some = np.repeat(length > 1, length)
        return batch_of(["list", "h1"], [np.repeat(key, length)[some], s[some]])

    held = [np.empty(0, np.int64)] * 2
    for batch in batches:
        held = [np.concatenate([x, column(batch, c)]) for x, c in zip(held, ("band", "h1"), strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
        if last:
            yield work(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if len(held[0]):
        yield work(*held)


def apart(n: np.ndarray, percent: int) -> np.ndarray:
    """Of sizes in order: where a run begins that cannot link with what stands before."""
    return np.flatnonzero(np.append(True, percent * n[1:] > 100 * n[:-1]))


def connected(n: np.ndarray, maps: np.ndarray, percent: int, limit: int) -> np.ndarray:
    """Of each set of a list: a set that it may be connected with, the same for all that are.

    Sets that no chain of pairs within the limits connects get different ones, up to what a list longer than MATRIX can
    tell: there runs of sizes and of distances to the first set of a run part them.
    """
    label = np.arange(len(n))
    if len(n) <= MATRIX:
        sizes = 100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None])
        return _labels(sizes & (odd_bits(maps, maps) <= limit))
    order = np.argsort(n, kind="stable")
    runs = np.split(order, apart(n[order], percent)[1:])
    while runs:
        run = runs.pop()
        if len(run) <= MATRIX:
            label[run] = run[connected(n[run], maps[run], percent, limit)] if len(run) else run
            continue
        far = odd_bits(maps[run[:1]], maps[run])[0]
        by = np.argsort(far, kind="stable")
        cut = np.flatnonzero(np.diff(far[by]) > limit) + 1
        if len(cut):
            runs += [run[x] for x in np.split(by, cut)]
        else:
            label[run] = run.min()
    return label


def _joined(percent: int, limit: int):
    """Of rows sorted by list: edges that connect the sets of a list that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def give() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            h1, n, data = zip(*held, strict=True)
            h1 = np.array(h1)
            maps = np.frombuffer(b"".join(data), "<u8").reshape(len(h1), -1)
            label = connected(np.array(n), maps, percent, limit)
            own = np.flatnonzero(label != np.arange(len(label)))
            if len(own):
                yield batch_of(["a", "b"], [h1[own], h1[label[own]]])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("list", "h1", "n", "sketch")), strict=True):
                if key != at:
                    yield from give()
                    at, held = key, []
                held.append(row)
        yield from give()

    return run


def _blocks(rows: DataFrame, maps: DataFrame, percent: int, limit: int, scratch: Scratch) -> DataFrame:
    """set, block: every set that may link with another one."""
    bands = rows.where("bands is not null").select("h1", "bands").mapInArrow(tidied(_banded), "band long, h1 long")
    lists = bands.repartition("band").sortWithinPartitions("band", "h1").mapInArrow(tidied(_listed), "list long, h1 long")
    lists = scratch.save(lists.distinct())
    edges = (
        lists.join(maps, "h1").repartition("list").sortWithinPartitions("list", "h1")
        .select("list", "h1", "n", "sketch").mapInArrow(tidied(_joined(percent, limit)), "a long, b long")
    )
    roots = components(scratch.save(edges.distinct()), scratch.save)
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).toDF("set", "block")


# ---------------------------------------------------------------- links


def _near(maps: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (of one part, or across two) that sizes and sketches do not rule out, and their odd bits."""
    other = left if right is None else right
    z = odd_bits(maps[left], maps[other])
    ok = z <= limit
    ok &= 100 * np.minimum(sizes[left][:, None], sizes[other][None]) >= percent * np.maximum(sizes[left][:, None], sizes[other][None])
    if right is None:
        ok &= np.tri(len(left), k=-1, dtype=bool)
    i, j = np.nonzero(ok)
    return left[i], other[j], z[i, j]


def _rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that the pairs connect each of n places with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def confirmed(values: list[np.ndarray], i: np.ndarray, j: np.ndarray, odd: np.ndarray, percent: int) -> np.ndarray:
    """``_rooted`` by those pairs that link on their full sets.

    First the most alike pair of each set, then the pairs that those do not connect.
    """
    sizes = np.array([len(v) for v in values], np.int64)
    none = np.empty(0, np.int64)

    def linked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = _overlaps(values, i, j)
        ok = 100 * common >= percent * (sizes[i] + sizes[j] - common)
        return i[ok], j[ok]

    order = np.argsort(odd, kind="stable")
    i, j = i[order], j[order]
    first = np.zeros(len(i), bool)
    for x in (i, j):
        first[np.unique(x, return_index=True)[1]] = True
    a, b = linked(i[first], j[first]) if first.any() else (none, none)
    label = _rooted(len(values), a, b)
    rest = ~first & (label[i] != label[j])
    if rest.any():
        c, d = linked(i[rest], j[rest])
        label = _rooted(len(values), np.concatenate([a, c]), np.concatenate([b, d]))
    return label


def _linked(rule: Rule, k: int, percent: int, limit: int):
    """Of rows sorted by pair of parts: two documents that confirmed links connect, a row for each set but the first."""

    def unit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, _, step, one, two = held[0][0]
        side, doc, data, values = zip(*(r[1:] for r in held), strict=True)
        side, doc = np.array(side), np.array(doc, np.int64)
        maps = np.frombuffer(b"".join(data), "<u8").reshape(len(held), -1)
        sizes = np.array([len(v) for v in values], np.int64)
        every = np.arange(len(held))
        left, right = (every, None) if step == 0 and one == two else (every[~side], every[side])
        i, j, odd = _near(maps, sizes, left, right, percent, limit)
        if len(i):
            label = confirmed(list(values), i, j, odd, percent)
            own = np.flatnonzero(label != every)
            if len(own):
                yield batch_of(["doc", "root"], [doc[own], doc[label[own]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[tuple] = set()
        for batch in batches:
            units = list(zip(*(batch.column(c).to_pylist() for c in _UNIT), strict=True))
            h1, h2, side, doc, sketch = (batch.column(c).to_pylist() for c in ("h1", "h2", "side", "doc", "sketch"))
            for block in blocks(batch.column("text"), rule):
                sets = Sets(block, k)
                for i, key in enumerate(zip(*(x.tolist() for x in sets.keys()), strict=True)):
                    row = block.rows.start + i
                    if held and held[0][0] != units[row]:
                        yield from unit(held)
                        held, seen = [], set()
                    # another text of the same id, or the same row again
                    if key != (h1[row], h2[row]) or key in seen:
                        continue
                    seen.add(key)
                    held.append((units[row], side[row], doc[row], sketch[row], sets.of(i).copy()))
        if held:
            yield from unit(held)

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, rule: Rule = LOWER
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; kept: the document has the smallest id of its group."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    docs = texts(docs, id_col, text_col)
    prepared(docs.sparkSession)
    limit = least_limit(percent, len(_SEEDS))
    with Scratch(docs.sparkSession, "sketches") as scratch:
        schema = "doc_id long, n long, h1 long, h2 long, bands binary, sketch binary"
        rows = scratch.save(docs.mapInArrow(tidied(_sketched(rule, k)), schema))
        every = rows.select("doc_id", "n", "h1", "h2")
        known = every.where("doc_id is not null and n > 0")
        key = F.struct("h1", "h2", "n")
        # an id with several texts links them; of each set the smallest id goes on
        ids = known.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y"))
        several = known.join(ids.where("x != y").select("doc_id"), "doc_id", "left_semi").distinct()
        sets = scratch.save(known.groupBy("h1", "h2").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc")))
        maps = scratch.save(rows.where("sketch is not null").select("h1", "n", "sketch").dropDuplicates(["h1"]))
        members = _blocks(rows, maps, percent, limit, scratch)
        members = sets.join(members, F.col("h1") == F.col("set")).drop("set")
        units = scratch.save(_units(members, percent).join(maps.select("h1", "sketch"), "h1"))
        near = scratch.save(
            sieved(docs, "doc_id", units.select("doc"))[0]
            .join(units, F.col("doc_id") == F.col("doc"))
            .select(*_UNIT, "side", "h1", "h2", "doc", "sketch", "text")
            .repartition(*_UNIT)
            .sortWithinPartitions(*_UNIT)
            .mapInArrow(tidied(_linked(rule, k, percent, limit)), "doc long, root long")
        )
        more = several.join(sets.select("h1", "h2", "doc"), ["h1", "h2"]).select("doc", F.col("doc_id").alias("root"))
        roots = components(near.unionByName(more), scratch.save)
        own = sets.join(roots, F.col("doc") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "doc").alias("component_id"))
        # written, so that Spark can split the join where one set has very many rows
        own = scratch.save(own)
        out = known.join(own, ["h1", "h2"]).select("doc_id", "n", "component_id")
        # an id of which another row has words is a node of that row's component
        rest = every.where("doc_id is null or n = 0").join(roots, F.col("doc_id") == F.col("node"), "left")
        rest = rest.select("doc_id", "n", F.coalesce("root", "doc_id").alias("component_id"))
        out = out.unionByName(rest).withColumn("kept", F.expr("doc_id = component_id"))
        return saved(out.withColumnRenamed("n", "n_shingles"))
