"""N-gram Jaccard join with signature trees.

A document is the set of its ``K``-word shingles; two documents link when 100 * |A & B| >= ``PERCENT`` * |A | B|.
The join is exact:

1. Equal sets collapse into one (128 bits of hash), so copies cost nothing further.
2. Shingles get one order for all documents: rare ones first, by finely divided counters of a sketch over all documents,
   then by hash.  Two linked sets share a shingle among the first n - ceil(t * n) + 1 of each; their sizes, and what follows
   the first common shingle in that order, bound their overlap.  Sets that share a shingle and are not ruled out by that
   are in one block; blocks are the components of these pairs.  The pairs of a shingle that few sets have are first
   tested as the leaves of a tree are (3), so that chance does not join blocks; copies share many shingles, so such sets
   travel as one list a shingle, and become pairs where equal lists have met.  A shingle of more sets connects those
   not ruled out without listing their pairs.  Shingles that the sketch calls frequent are dealt out with a salt, and
   connect all sets of similar size.
3. A block of more than ``UNIT`` sets is dealt into parts by size and hash, and only parts of sizes that can link meet.
   Each part gets a signature tree: leaves hold the token bitmaps of a few sets of similar size, nodes the OR of their
   bitmaps, the range of their sizes and the most tokens that share a bit.  A dual traversal from both roots drops node
   pairs whose sizes or greatest possible overlap cannot reach the threshold.
4. Pairs that are left are verified on the whole sets, many at once as a product of 0/1 matrices.  Only sums and a star
   for each connected group leave the worker, so a group of n near copies makes no n * n rows unless the caller asks for
   the links themselves (``similar_pairs``).
5. Components of the links: local union-find; where a worker cannot hold what is left, large-star and small-star steps
   until nothing changes.

Texts are read three times: for sets and the sketch, for the first shingles, and those of blocks for the links.  The last
are dealt out twice, compressed: by document and by pair of parts.

Null, empty and blank texts have no shingles and link with nothing.  Fewer than K words make one shingle.  Rows with
one id count as one document.  A null id gets its n_shingles and a null component, and no n_links.  Further columns play
no part, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, Seen, batch_of, column, longs, packed, prepared, saved, sieved, starts_of, texts, tidied, unpacked
from .words import LOWER, Block, Rule, blocks, kgrams, mix

K, PERCENT = 5, 80
LEAST_BITS, MOST_BITS, SHINGLE_BYTES, CHUNKS = 16, 24, 128, 256  # counters of the sketch: one for so many bytes of text
FINE = 32  # levels of counters that chance may fill, of 64
LEAF, FANOUT, LEAST_WIDTH, MOST_WIDTH = 16, 4, 256, 1 << 14
SMALL_LIST, PART = 32, 2048  # sets of a shingle whose pairs are looked at one by one, or in one matrix
EDGES = 1_000_000
UNIT, UNIT_SHINGLES, TOKENS = 256, 1 << 20, 4096  # sets and shingles in a part of a block; columns of a 0/1 matrix at once
FEW = 64  # pairs compared one by one

_H2 = np.uint64(0xA5A5F00DCAFE1234)
_LEVEL, _SALT = np.uint64(58), np.uint64(0xFFFF)
_REST = np.uint64((1 << 58) - 1)


# ---------------------------------------------------------------- sets


class Sets:
    """The shingle sets of a block, one document after another, each in the order of its hashes."""

    def __init__(self, block: Block, k: int):
        inside = np.flatnonzero(block.inside(k))
        value = kgrams(block.hashes, k)[inside]
        long_ = np.where(block.sizes >= k, block.sizes - k + 1, 0)
        short = np.flatnonzero((block.sizes > 0) & (block.sizes < k))
        number = long_.copy()
        number[short] = 1
        first = np.concatenate([[0], np.cumsum(number)])
        v = np.empty(int(first[-1]), np.uint64)
        at = np.ones(len(v), bool)
        at[first[short]] = False
        v[at] = value
        for n in range(1, k):
            of = short[block.sizes[short] == n]
            if len(of):
                v[first[of]] = kgrams(block.hashes, n)[block.first[of]] + np.uint64(n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            v[a:b].sort()
        own = np.repeat(np.arange(len(number)), number)
        start = starts_of(own, v)
        self.own, self.value = own[start], v[start]
        self.n = np.bincount(self.own, minlength=len(block.sizes))
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def _sums(self, x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
        return mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self._sums(mix(self.value)).view(np.int64), self._sums(mix(self.value ^ _H2)).view(np.int64)

    def bitmap(self, i: int) -> bytes:
        """A bit a shingle or up to two; a power of two, so that larger ones fold onto smaller ones."""
        bits = np.zeros(max(64, 1 << (int(self.n[i]) - 1).bit_length()), np.uint8)
        bits[(self.of(i) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    def of(self, i: int) -> np.ndarray:
        return self.value[self.first[i] : self.first[i + 1]]


def _described(rule: Rule, k: int, bits: int):
    """A row for each document, with a bitmap where the worker meets its set for the first time; and the worker's counters
    of shingles (of different sets) in CHUNKS further rows."""
    names = ["doc_id", "n", "h1", "h2", "chunk", "data"]  # data: the document's bitmap, or counters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
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
                np.add.at(total, (sets.value[fresh[sets.own]] >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
                maps = pa.array([sets.bitmap(i) if new else None for i, new in enumerate(fresh.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([ids[block.rows], longs(sets.n), longs(h1), longs(h2), pa.nulls(len(h1), pa.int64()), maps], names)
        none = pa.nulls(CHUNKS, pa.int64())
        data = [_squeezed(x) for x in np.split(total, CHUNKS)]
        yield pa.RecordBatch.from_arrays([none, none, none, none, longs(np.arange(CHUNKS)), pa.array(data, pa.binary())], names)

    return run


# ---------------------------------------------------------------- arrays of fixed size


def _squeezed(x: np.ndarray) -> bytes:
    """Counters as bytes: their width, and then the narrowest type that holds them, Huffman-coded (most are 0 or 1)."""
    x = x.astype(np.min_scalar_type(x.max(initial=0)))
    how = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return bytes([x.itemsize]) + how.compress(x.tobytes()) + how.flush()


def _counters(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:], -15), f"<u{data[0]}").astype(np.uint64)


def _summed(pieces: DataFrame, size: int) -> np.ndarray:
    """One array of ``size`` counters from rows (chunk, data) of several workers; CHUNKS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held[chunk] = held[chunk] + _counters(data) if chunk in held else _counters(data)
        if held:
            yield pa.RecordBatch.from_arrays([longs(list(held)), pa.array([_squeezed(x) for x in held.values()], pa.binary())], ["chunk", "data"])

    out = np.zeros(size, np.float32)
    step = size // CHUNKS
    for r in pieces.repartition(F.col("chunk")).mapInArrow(tidied(run), "chunk long, data binary").toLocalIterator():
        out[r.chunk * step : (r.chunk + 1) * step] = _counters(r.data)
    return out


class Order:
    """How common the shingles of each counter are: FINE even steps as far as chance fills a counter, then a step a
    doubling of what lies above the mean; and into how many parts a shingle of each level is dealt.

    Chance alone spreads a counter over all the fine steps, but a shingle of some tens of sets lifts its own by several.
    So it stands behind the first shingles of its sets even where the sketch is too full to call it frequent; otherwise
    such shingles would join unlike sets to ever larger blocks as the table grows.
    """

    def __init__(self, counts: np.ndarray, mean: float, part: int):
        noise = 4 * np.sqrt(mean) + 4
        least = max(-noise, -mean)
        above = counts - np.float32(mean)
        fine = np.clip(np.floor((above - least) * (FINE / (noise - least))), 0, FINE - 1)
        coarse = FINE + np.floor(np.log2(np.maximum(above, noise) / noise))
        self.level = np.where(above < noise, fine, np.minimum(63, coarse)).astype(np.uint8)
        self.shift = np.uint64(64 - int(len(counts)).bit_length() + 1)
        doublings = np.maximum(0, np.arange(64) - FINE + 1)
        self.salts = np.minimum(1 << 16, np.maximum(1, noise * 2.0**doublings // (2 * part))).astype(np.uint64)

    def of(self, values: np.ndarray) -> np.ndarray:
        """The values with the level in place of the topmost bits: sorted, they stand in the order."""
        return self.level[(values >> self.shift).astype(np.int64)].astype(np.uint64) << _LEVEL | values & _REST


# ---------------------------------------------------------------- blocks


def least_overlap(a, b, percent: int):
    """Common shingles that sets of sizes a and b need to link."""
    return -(-percent * (a + b) // (100 + percent))


def _prefixes(rule: Rule, k: int, percent: int, order):
    """shingle, size, set: the first shingles of each set, each set once a worker as far as its memory of sets goes.

    size: the set's size in the upper half, and what follows the shingle in the order, itself included, in the lower
    one; negative where the shingle carries a salt in its last 16 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for block in blocks(batch.column("text"), rule):
                sets = Sets(block, k)
                h1 = sets.keys()[0]
                w = order.value.of(sets.value)
                for a, b in zip(sets.first[:-1].tolist(), sets.first[1:].tolist(), strict=True):
                    w[a:b].sort()
                length = sets.n + (-percent * sets.n) // 100 + 1
                place = np.arange(len(w)) - sets.first[sets.own]
                take = np.flatnonzero((place < length[sets.own]) & seen.fresh(h1)[sets.own])
                own, w = sets.own[take], w[take]
                size = sets.n[own] << 32 | sets.n[own] - place[take]
                salts = order.value.salts[w >> _LEVEL]
                many = salts > 1
                w[many] = w[many] & ~_SALT | mix(h1[own[many]].view(np.uint64)) % salts[many]
                size[many] = -size[many]
                yield batch_of(["shingle", "size", "set"], [w.view(np.int64), size, h1[own]])

    return run


def _labels(link: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric matrix, or of each of several matrices: the first one that it is connected with."""
    n = link.shape[-1]
    label = np.broadcast_to(np.arange(n), link.shape[:-1])
    while True:
        new = np.minimum(label, np.where(link, label[..., None, :], n).min(axis=-1))
        new = np.take_along_axis(new, new, axis=-1)
        if (new == label).all():
            return label
        label = new


def _edges(percent: int, whole: bool = False):
    """Of rows sorted by shingle, size and set: pairs of sets that are not ruled out (low 1), or for a longer list pairs
    that connect all those (low 0).

    ``whole``: three sets or more that the pairs of a shingle connect are one row, their keys in order (list) and the
    smallest of them (a), so that a shingle never gives more than its sets.

    A salted shingle gives runs of sets of similar size instead: its key, their least and greatest size, and a set.
    """
    names = ["a", "b", "key", "low", "high", "list"]

    def pairs(n: np.ndarray, reach: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(n[at], n[other]) >= percent * np.maximum(n[at], n[other])
        return ok & (np.minimum(reach[at], reach[other]) >= least_overlap(n[at], n[other], percent))

    def runs(n: np.ndarray) -> np.ndarray:
        """Where sizes leap so far that what stands before cannot link with what comes."""
        return np.flatnonzero(np.append(True, 100 * n[:-1] < percent * n[1:]))

    def work(t: np.ndarray, size: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = starts_of(t, size, s)
        t, size, s = t[new], size[new], s[new]
        start = starts_of(t)
        length = np.diff(np.append(start, len(t)))
        salted = size[start] < 0
        n, reach = np.abs(size) >> 32, np.abs(size) & 0xFFFFFFFF
        found: list[np.ndarray] = []
        stars: list[np.ndarray] = []
        lists: set[bytes] = set()
        for l in np.unique(length[(length > 1) & (length <= SMALL_LIST) & ~salted]).tolist():
            at = start[(length == l) & ~salted]
            if whole and l > 2:
                i = at[:, None] + np.arange(l)
                group = at[:, None] + _labels(pairs(n, reach, i[:, :, None], i[:, None]))
                members = np.stack([s[i].ravel(), group.ravel()])
                members = members[:, np.lexsort(members)]
                first = starts_of(members[1])
                number = np.diff(np.append(first, members.shape[1]))
                two = first[number == 2]
                found.append(np.stack([members[0, two], members[0, two + 1]]))
                lists.update(members[0, x : x + y].tobytes() for x, y in zip(first[number > 2].tolist(), number[number > 2].tolist(), strict=True))
                continue
            for i in range(l):
                for j in range(i + 1, l):
                    ok = pairs(n, reach, at + i, at + j)
                    found.append(np.stack([s[at[ok] + i], s[at[ok] + j]]))
        for a, l in zip(*(x[(length > SMALL_LIST) & ~salted].tolist() for x in (start, length)), strict=True):
            if l <= PART:
                i = np.arange(a, a + l)
                link = pairs(n, reach, i[:, None], i[None])
                label = a + _labels(link)
            else:
                first = runs(n[a : a + l])
                label = a + np.repeat(first, np.diff(np.append(first, l)))
            stars.append(np.stack([s[label], s[a : a + l]]))
        for tested, some in ((1, found), (0, stars)):
            if some:
                e = np.sort(np.concatenate(some, axis=1), axis=0)
                e = e[:, e[0] < e[1]]
                e = e[:, np.lexsort(e)]
                e = e[:, starts_of(*e)]
                none, no_list = pa.nulls(e.shape[1], pa.int64()), pa.nulls(e.shape[1], pa.binary())
                yield pa.RecordBatch.from_arrays([longs(e[0]), longs(e[1]), none, longs(np.full(e.shape[1], tested)), none, no_list], names)
        if lists:
            none = pa.nulls(len(lists), pa.int64())
            heads = longs([np.frombuffer(x, np.int64, 1)[0] for x in lists])
            yield pa.RecordBatch.from_arrays([heads, none, none, none, none, pa.array(list(lists), pa.binary())], names)
        if salted.any():
            for a, l in zip(start[salted].tolist(), length[salted].tolist(), strict=True):
                order = np.argsort(n[a : a + l], kind="stable") + a
                first = runs(n[order])
                last = np.append(first[1:], l) - 1
                rep = s[order[first]]
                key, none = np.full(len(rep), t[a] >> 16), pa.nulls(len(rep), pa.int64())
                ends = longs(n[order[first]]), longs(n[order[last]])
                yield pa.RecordBatch.from_arrays([longs(rep), none, longs(key), *ends, pa.nulls(len(rep), pa.binary())], names)
                e = np.stack([np.repeat(rep, last - first + 1), s[order]])
                e = e[:, e[0] != e[1]]
                none = pa.nulls(e.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([longs(e[0]), longs(e[1]), none, longs(np.zeros(e.shape[1])), none, pa.nulls(e.shape[1], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, column(batch, c)]) for x, c in zip(held, ("shingle", "size", "set"), strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0  # may go on in the next batch
            if last:
                yield from work(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield from work(*held)

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each list, those of lists with one head once; rows sorted by head."""
    head, lists = None, set()

    def give() -> Iterator[pa.RecordBatch]:
        each: dict[int, list[np.ndarray]] = {}
        for x in lists:
            x = np.frombuffer(x, np.int64)
            each.setdefault(len(x), []).append(x)
        e = []
        for l, same in each.items():
            i, j = np.triu_indices(l, 1)
            same = np.stack(same)
            e.append(np.stack([same[:, i].ravel(), same[:, j].ravel()]))
        if e:
            e = np.concatenate(e, axis=1)
            e = e[:, np.lexsort(e)]
            yield batch_of(["a", "b"], list(e[:, starts_of(*e)]))

    for batch in batches:
        for h, x in zip(batch.column("head").to_pylist(), batch.column("list").to_pylist(), strict=True):
            if h != head:
                yield from give()
                head, lists = h, set()
            lists.add(x)
    yield from give()


# ---------------------------------------------------------------- components


class Forest:
    """Union-find over ids."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a worker as stars around the smallest member of what they connect, EDGES at a time."""
    joined = Forest()

    def give() -> Iterator[pa.RecordBatch]:
        rows = [(x, r) for x in list(joined.parent) if (r := joined.find(x)) != x]
        joined.parent.clear()
        if rows:
            yield batch_of(["node", "root"], list(np.array(rows, np.int64).T))

    for batch in batches:
        for x, y in zip(column(batch, "node").tolist(), column(batch, "root").tolist(), strict=True):
            joined.join(x, y)
        if len(joined.parent) >= EDGES:
            yield from give()
    yield from give()


def components(links: DataFrame, save: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """node, root (the smallest id connected with it) of every node but the roots; links: two columns of ids.

    Each round makes stars locally, then hangs every neighbour on the smallest one (large star for larger neighbours,
    small star for the rest), until each node has one root and no root hangs on another.
    """
    a, b = links.columns
    schema = "node long, root long"
    edges = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node > root").distinct()
    edges = save(edges.mapInArrow(tidied(_stars), schema).distinct())
    if edges.count() < EDGES // 2:  # then one worker's union-find holds all of them
        return save(edges.coalesce(1).mapInArrow(tidied(_stars), schema))
    while True:
        least = edges.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("top"))
        hanging = edges.select(F.col("root").alias("node")).join(least, "node", "left_semi")
        if least.where("low < top").isEmpty() and hanging.isEmpty():
            return edges
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("low")).withColumn("low", F.least("node", "low"))
        large = both.where("root > node").join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).where("node > root")
        small = small.unionByName(low.select("node", F.col("low").alias("root")))
        edges = save(small.distinct().mapInArrow(tidied(_stars), schema).distinct())


def _possible(percent: int):
    """The pairs a, b that their bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = column(batch, "na"), column(batch, "nb")
            need = least_overlap(na, nb, percent)
            ok = np.zeros(len(na), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                width = min(len(x), len(y))
                x, y = (np.bitwise_or.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
                ok[i] = min(na[i] - _ones(x & ~y), nb[i] - _ones(y & ~x)) >= need[i]
            yield batch_of(["a", "b"], [column(batch, "a")[ok], column(batch, "b")[ok]])

    return run


def _blocks(docs: DataFrame, rows: DataFrame, order, rule: Rule, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """set, block: every set that shares a block with another one; a block goes by its smallest set."""
    found = scratch.save(
        docs.mapInArrow(tidied(_prefixes(rule, k, percent, order)), "shingle long, size long, set long")
        .repartition("shingle")
        .sortWithinPartitions("shingle", "size", "set")
        .mapInArrow(tidied(_edges(percent, whole=True)), "a long, b long, key long, low long, high long, list binary")
    )
    lists = found.where("list is not null").select(F.col("a").alias("head"), "list")
    pairs = lists.repartition("head").sortWithinPartitions("head").mapInArrow(tidied(_paired), "a long, b long")
    pairs = scratch.save(found.where("b is not null and low = 1").select("a", "b").unionByName(pairs).distinct())
    ends = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct()
    maps = rows.where("chunk is null and data is not null").select("h1", "n", "data").join(ends, "h1", "left_semi").dropDuplicates(["h1"])
    maps = scratch.save(maps)
    near = pairs.join(maps.toDF("a", "na", "x"), "a").join(maps.toDF("b", "nb", "y"), "b").mapInArrow(tidied(_possible(percent)), "a long, b long")
    by_size = Window.partitionBy("key").orderBy("low", "high", "a")
    before = F.max("high").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.where("key is not null").withColumn("leap", F.coalesce(100 * before < percent * F.col("low"), F.lit(True)).cast("long"))
    runs = runs.withColumn("run", F.sum("leap").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("a").over(Window.partitionBy("key", "run").orderBy("low", "high", "a"))
    edges = found.where("b is not null and low = 0").select("a", "b").unionByName(runs.select("a", first.alias("b"))).unionByName(near)
    roots = components(edges, scratch.save)
    for x in (found, pairs, maps):
        scratch.drop(x)
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).toDF("set", "block")


# ---------------------------------------------------------------- signature trees


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def bitmaps(owner: np.ndarray, values: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, width), np.uint8)
    bits[owner, (values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


class Node:
    __slots__ = ("bits", "high", "items", "kids", "low", "shared")

    def __init__(self, items: np.ndarray, kids: list[Node], bits: np.ndarray, low: int, high: int, shared: int):
        self.items, self.kids, self.bits, self.low, self.high, self.shared = items, kids, bits, low, high, shared


class Tree:
    """Signature tree over some sets in the order of their sizes; sizes and maps are those of all sets of a worker's unit."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray, maps: np.ndarray, percent: int):
        self.n, self.maps, self.percent = sizes, maps, percent
        shared = sizes - _ones(maps)  # tokens beyond one a bit
        order = items[np.lexsort((items, sizes[items]))]
        level = [
            Node(o, [], np.bitwise_or.reduce(maps[o], axis=0), int(sizes[o].min()), int(sizes[o].max()), int(shared[o].max()))
            for o in np.split(order, range(LEAF, len(order), LEAF))
        ]
        while len(level) > 1:
            level = [
                Node(
                    np.concatenate([x.items for x in g]), g, reduce(np.bitwise_or, (x.bits for x in g)),
                    min(x.low for x in g), max(x.high for x in g), max(x.shared for x in g),
                )
                for g in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))
            ]
        self.root = level[0]

    def hopeless(self, x: Node, y: Node) -> bool:
        if 100 * min(x.high, y.high) < self.percent * max(x.low, y.low):
            return True
        most = min(int(_ones(x.bits & y.bits)) + min(x.shared, y.shared), x.high, y.high)
        return most < least_overlap(x.low, y.low, self.percent)

    def near(self, x: Node, y: Node) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of two leaves that their own bitmaps do not rule out."""
        a, b = self.maps[x.items], self.maps[y.items]
        na, nb = self.n[x.items], self.n[y.items]
        most = np.minimum(na[:, None] - _ones(a[:, None] & ~b[None]), nb[None] - _ones(b[None] & ~a[:, None]))
        ok = most >= least_overlap(na[:, None], nb[None], self.percent)
        ok &= 100 * np.minimum(na[:, None], nb[None]) >= self.percent * np.maximum(na[:, None], nb[None])
        if x is y:
            ok &= np.tri(len(na), k=-1, dtype=bool)
        i, j = np.nonzero(ok)
        return x.items[i], y.items[j]

    def pairs(self, other: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a set of this tree with one of the other (or this same) tree that may link."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        stack = [(self.root, other.root)]
        while stack:
            x, y = stack.pop()
            if self.hopeless(x, y):
                continue
            if not x.kids and not y.kids:
                found.append(self.near(x, y))
            elif x is y:
                stack += [(a, b) for i, a in enumerate(x.kids) for b in x.kids[: i + 1]]
            else:
                stack += [(a, b) for a in x.kids or [x] for b in y.kids or [y]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---------------------------------------------------------------- links


_UNIT = ("block", "band", "step", "i", "j")  # a pair of parts: i of a band, j of the same band or of the next one


def _units(sets: DataFrame, percent: int) -> DataFrame:
    """sets (h1, h2, block, n and more) once for each pair of parts they belong to; side: which of the two."""
    step = -np.log(percent / 100) * 1.001 + 1e-9  # sets of sizes that can link are at most one band apart
    parts_of = F.ceil(F.greatest(F.count("*") / UNIT, F.sum("n") / UNIT_SHINGLES))
    sizes = sets.groupBy("block").agg(parts_of.alias("size"))
    band = F.when(F.col("size") <= 1, 0).otherwise(F.floor(F.log("n") / step)).cast("long")
    sets = sets.join(sizes, "block").withColumn("band", band).drop("size")
    parts = sets.groupBy("block", "band").agg(parts_of.alias("parts"))
    for name, by in (("own", 0), ("after", -1), ("before", 1)):
        sets = sets.join(parts.select("block", (F.col("band") + by).alias("band"), F.col("parts").alias(name)), ["block", "band"], "left")
    sets = sets.withColumn("at", F.pmod(F.xxhash64("h1", "h2"), "own"))

    def each(n: str, unit: str) -> Column:
        return F.expr(f"transform(if({n} is null, array(), sequence(0L, {n} - 1)), p -> {unit})")

    every = F.concat(
        each("own", "struct(band, 0 as step, least(at, p) as i, greatest(at, p) as j, at > p as side)"),
        each("after", "struct(band, 1 as step, at as i, p as j, false as side)"),
        each("before", "struct(band - 1 as band, 1 as step, p as i, at as j, true as side)"),
    )
    sets = sets.withColumn("unit", F.explode(every)).drop("band", "own", "after", "before", "at")
    return sets.select("*", "unit.*").drop("unit")


def _common(owner: np.ndarray, values: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common values of each set of ``left`` with each of ``right``."""
    _, token, times = np.unique(values, return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[token]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for t in range(0, int((times > 1).sum()), TOKENS):
        a, b = np.searchsorted(place, (t, t + TOKENS))
        m = np.zeros((n, int(place[b - 1]) - t + 1), np.float32)
        m[owner[a:b], place[a:b] - t] = 1
        common += (m[left] @ m[right].T).astype(np.int64)
    return common


def _overlaps(values: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common values of the pairs of sets."""
    if len(i) <= FEW:
        each = [len(np.intersect1d(values[a], values[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        return np.array(each, np.int64)
    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    sizes = [len(values[x]) for x in some.tolist()]
    left, a = np.unique(at[: len(i)], return_inverse=True)
    right, b = np.unique(at[len(i) :], return_inverse=True)
    owner = np.repeat(np.arange(len(some)), sizes)
    return _common(owner, np.concatenate([values[x] for x in some.tolist()]), len(some), left, right)[a, b]


def _links_of(values: list[np.ndarray], side: np.ndarray, percent: int, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs of a unit, with their common values: within one part (``alone``), or across the two sides."""
    none = np.empty(0, np.int64)
    sizes = np.array([len(v) for v in values], np.int64)
    left, right = (np.arange(len(values)), None) if alone else (np.flatnonzero(~side), np.flatnonzero(side))
    if len(values) < 2 or right is not None and not (len(left) and len(right)):
        return none, none, none
    width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << int(2 * sizes.max()).bit_length()))
    maps = bitmaps(np.repeat(np.arange(len(values)), sizes), np.concatenate(values), len(values), width)
    tree = Tree(left, sizes, maps, percent)
    i, j = tree.pairs(tree if right is None else Tree(right, sizes, maps, percent))
    if not len(i):
        return none, none, none
    common = _overlaps(values, i, j)
    link = 100 * common >= percent * (sizes[i] + sizes[j] - common)
    return i[link], j[link], common[link]


def _linked(rule: Rule, k: int, percent: int, listed: bool):
    """Of rows sorted by pair of parts: for each set that links the documents it links with, and a set that it is
    connected with there, by their docs; and a row (o1, o2 not null) for each of its links with a marked set.
    ``listed``: the links themselves, as two docs and their common shingles."""
    names = ["h1", "h2", "doc", "root", "n", "o1", "o2"]

    def unit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, _, step, one, two = held[0][0]
        keys, side, doc, weight, marked, values = zip(*(r[1:] for r in held), strict=True)
        keys, doc, weight = np.array(keys, np.int64), np.array(doc, np.int64), np.array(weight, np.int64)
        i, j, common = _links_of(list(values), np.array(side), percent, step == 0 and one == two)
        if not len(i):
            return
        if listed:
            ends = np.sort(np.stack([doc[i], doc[j]]), axis=0)
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, longs(ends[0]), longs(ends[1]), longs(common), none, none], names)
            return
        label = np.arange(len(held))
        while True:
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        n = np.zeros(len(held), np.int64)
        np.add.at(n, i, weight[j])
        np.add.at(n, j, weight[i])
        some = np.unique(np.concatenate([i, j]))
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([*map(longs, (keys[some, 0], keys[some, 1], doc[some], doc[label[some]], n[some])), none, none], names)
        mark = np.array(marked)
        one, other = np.concatenate([i, j]), np.concatenate([j, i])
        one, other = one[mark[other]], other[mark[other]]
        if len(one):
            none = pa.nulls(len(one), pa.int64())
            yield pa.RecordBatch.from_arrays([longs(keys[one, 0]), longs(keys[one, 1]), none, none, none, longs(keys[other, 0]), longs(keys[other, 1])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[tuple] = set()
        for batch in batches:
            units = list(zip(*(batch.column(c).to_pylist() for c in _UNIT), strict=True))
            h1, h2, side, doc, n, marked = (batch.column(c).to_pylist() for c in ("h1", "h2", "side", "doc", "docs", "several"))
            for block in blocks(unpacked(batch), rule):
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
                    held.append((units[row], key, side[row], doc[row], n[row], marked[row], sets.of(i).copy()))
        if held:
            yield from unit(held)

    return run


def _links(docs: DataFrame, sets: DataFrame, rule: Rule, k: int, percent: int, scratch: Scratch, listed: bool = False) -> DataFrame:
    """See ``_linked``; sets: h1, h2, doc, n, docs, several, block."""
    units = scratch.save(_units(sets, percent))
    return scratch.save(
        packed(sieved(docs, "doc_id", units.select("doc"))[0])
        .join(units, F.col("doc_id") == F.col("doc"))
        .select(*_UNIT, "side", "h1", "h2", "doc", "docs", "several", "n_bytes", "packed")
        .repartition(*_UNIT)
        .sortWithinPartitions(*_UNIT)
        .mapInArrow(tidied(_linked(rule, k, percent, listed)), "h1 long, h2 long, doc long, root long, n long, o1 long, o2 long")
    )


# ---------------------------------------------------------------- join


def _described_sets(docs: DataFrame, k: int, percent: int, rule: Rule, part: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every row (doc_id, n, h1, h2); the sets of ids with several ones; each set (h1, h2, n, doc: its smallest id,
    docs: ids that have no other, several: whether others have it too); and the sets in blocks."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // SHINGLE_BYTES).bit_length()))
    rows = scratch.save(docs.mapInArrow(tidied(_described(rule, k, bits)), "doc_id long, n long, h1 long, h2 long, chunk long, data binary"))
    every = rows.where("chunk is null").select("doc_id", "n", "h1", "h2")
    counts = _summed(rows.where("chunk is not null").select("chunk", "data"), 1 << bits)
    order = docs.sparkSession.sparkContext.broadcast(Order(counts, float(counts.mean(dtype=np.float64)), part))
    known = every.where("doc_id is not null and n > 0")
    key = F.struct("h1", "h2", "n")
    ids = known.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y"))
    several = known.join(ids.where("x != y").select("doc_id"), "doc_id", "left_semi").distinct()
    lines = ids.where("x = y").select("doc_id", "x.*", F.lit(1).alias("docs"), F.lit(False).alias("several"))
    lines = lines.unionByName(several.withColumns({"docs": F.lit(0), "several": F.lit(True)}))
    sums = [F.min("n").alias("n"), F.min("doc_id").alias("doc"), F.sum("docs").alias("docs"), F.max("several").alias("several")]
    sets = scratch.save(lines.groupBy("h1", "h2").agg(*sums))
    members = _blocks(docs.where("doc_id is not null"), rows, order, rule, k, percent, scratch)
    return every, several, sets, sets.join(members, F.col("h1") == F.col("set")).drop("set")


def similar_pairs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, rule: Rule = LOWER, part: int = PART
) -> DataFrame:
    """a, b, n_common of every link between different sets; a set goes by the smallest id that has it."""
    docs = texts(docs, id_col, text_col)
    prepared(docs.sparkSession)
    with Scratch(docs.sparkSession, "pairs") as scratch:
        *_, members = _described_sets(docs, k, percent, rule, part, scratch)
        pairs = _links(docs, members, rule, k, percent, scratch, listed=True)
        return saved(pairs.select(F.col("doc").alias("a"), F.col("root").alias("b"), F.col("n").alias("n_common")))


def join_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    percent: int = PERCENT,
    rule: Rule = LOWER,
    part: int = PART,
    links: bool = True,
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row.

    n_links: the other documents that the row's text links with, copies of its set among them.  ``links`` False: without
    n_links.  ``part``: sets of a frequent shingle that one salt takes.
    """
    docs = texts(docs, id_col, text_col)
    prepared(docs.sparkSession)
    with Scratch(docs.sparkSession, "join") as scratch:
        every, several, sets, members = _described_sets(docs, k, percent, rule, part, scratch)
        found = _links(docs, members, rule, k, percent, scratch)
        near = found.where("o1 is null")
        edges = several.join(sets.select("h1", "h2", "doc"), ["h1", "h2"]).select("doc", F.col("doc_id").alias("root"))
        roots = components(near.select("doc", "root").unionByName(edges), scratch.save)
        near = near.groupBy("h1", "h2").agg(F.sum("n").alias("near"))
        # documents with several texts count once, whichever of them links
        marked = sets.where("several").select("h1", "h2", F.col("h1").alias("o1"), F.col("h2").alias("o2"))
        marked = marked.unionByName(found.where("o1 is not null").select("h1", "h2", "o1", "o2"))
        more = marked.join(several.select("doc_id", F.col("h1").alias("o1"), F.col("h2").alias("o2")), ["o1", "o2"])
        more = more.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("more"))
        own = sets.join(near, ["h1", "h2"], "left").join(more, ["h1", "h2"], "left").join(roots, F.col("doc") == F.col("node"), "left")
        n_links = F.expr("docs + coalesce(near, 0) + coalesce(more, 0) - 1").alias("n_links")
        # written, so that the join below has two plain sides, which Spark can split where one set has very many rows
        own = scratch.save(own.select("h1", "h2", F.coalesce("root", "doc").alias("component_id"), n_links))
        names = ["doc_id", "n", "component_id", *(["n_links"] if links else [])]
        # an id of which another row has words is a node of that row's component
        rest = every.where("doc_id is null or n = 0").join(roots, F.col("doc_id") == F.col("node"), "left")
        rest = rest.withColumn("component_id", F.coalesce("root", "doc_id")).withColumn("n_links", F.expr("if(doc_id is null, null, 0L)"))
        out = every.where("doc_id is not null and n > 0").join(own, ["h1", "h2"]).select(*names)
        return saved(out.unionByName(rest.select(*names)).withColumnRenamed("n", "n_shingles"))
