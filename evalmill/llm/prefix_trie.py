"""The trie of conversations by their first turns: who shares how much with whom.

A node is a distinct sequence of first turns (role and text); its members are the conversations that start with it, and it
goes by its smallest member and its depth.  A conversation that is the smallest member of a node is that of every deeper
node on its own path, so it owns a chain: the nodes from its first owned depth to its end.

1. Turns are placed by ``turn`` (null first; equal ones by the MD5 of role and text) and become digests.  Running exclusive
   ors of digests and places give every prefix a digest of 128 bits (``running``: a conversation may be of any length).
2. Minima: the smallest member of each prefix, with the number of its members, from one aggregation.
3. Each conversation finds its first owned depth by binary search.  A round joins the conversations still searching with
   their prefix in the middle, and that with its minimum; beyond the last round of the longest conversation none is left.
   The minimum met last above the first owned depth owns the chain that this one hangs on.
4. Chains form a tree, the root belonging to the smallest conversation of all.  Leaves and saved tokens of whole subtrees
   are added up from the bottom by doubling: after round k each chain holds the sums of those less than 2^k chains below.
   Running sums from a chain's end upwards then give them for every node.
5. The ids of conversations that end at a node are hashed in order, from chunks of CHUNK ids; a text's hash takes its bytes
   one after another, but no task holds them all.

Null roles and texts count as empty; rows that come again are further turns; rows without conv_id belong to no conversation.
Texts are read once and only for their MD5 and length.  A conversation without turns is a member of the root (``rebuilt``
makes some).  An empty table has no root and gives an empty result.  Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, longs, prepared, saved, tidied
from .running import running

CHUNK = 4096
FEW = 10_000  # conversations still searching that are sent to every task
GROUP, HEAD = 100, 6


def placed(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place (from 1), key and chars (code points) of every turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))).alias("key"),
        F.length(text("text")).cast("long").alias("chars"),
    )
    return running(turns, "conv_id", ["turn", "key"], scratch).drop("turn")


def rebuilt(turns: DataFrame, scratch: Scratch, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """Conversations that begin like the first of their ``group``: of conversation c the first h turns are those of
    c - c % group, as far as it has any, with h the CRC32 of c in decimal modulo ``head``; c's own turns after its first h
    follow.  A conversation that ends up without turns keeps one row, with a null place.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(head))
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = scratch.save(turns.where(base == F.col("conv_id")).where(F.col("place") < head).withColumnRenamed("conv_id", "base"))
    convs = turns.where("place = 1").select("conv_id", base.alias("base"), h.alias("h"))
    shared = convs.join(heads, "base").where("place <= h").select("conv_id", "place", "key", "chars")
    sizes = scratch.save(heads.groupBy("base").agg(F.max("place").alias("_n")))
    own = turns.withColumn("base", base).withColumn("h", h).where("place > h").join(sizes, "base", "left")
    own = own.withColumn("place", F.expr("place - h + least(h, coalesce(_n, 0L))")).select("conv_id", "place", "key", "chars")
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("place", "long"), ("key", "string"), ("chars", "long"))]
    every = convs.select("conv_id", *nulls)  # a row for each, so that those without turns stay
    return scratch.save(shared.unionByName(own).unionByName(every))


def _searched(ids: DataFrame, prefixes: DataFrame, minima: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """conv_id, top (first owned depth; beyond the end where it owns none), size (turns) and parent (the owner above top)."""
    sizes = prefixes.groupBy("conv_id").agg(F.max("place").alias("size"))
    state = ids.join(sizes, "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).alias("size"))
    # the smallest conversation owns its whole path, and the root is above all others
    smallest = F.col("conv_id") == least
    state = scratch.save(
        state.select(
            "conv_id", "size", F.when(smallest, 0).otherwise(1).cast("long").alias("low"),
            F.when(smallest, 0).otherwise(F.col("size") + 1).cast("long").alias("high"), F.when(~smallest, F.lit(least)).alias("parent"),
        )
    )
    done = [state.where("low = high")]
    digests = prefixes.select("conv_id", F.col("place").alias("middle"), "x1", "x2")
    owners = minima.select(F.col("place").alias("middle"), "x1", "x2", "owner")
    while left := state.where("low < high").count():
        sent = F.broadcast if left <= FEW else lambda df: df
        asked = state.where("low < high").withColumn("middle", F.expr("(low + high) div 2"))
        asked = digests.join(sent(asked), ["conv_id", "middle"])
        asked = owners.join(sent(asked), ["middle", "x1", "x2"])
        owned = F.col("owner") == F.col("conv_id")
        state = scratch.save(
            asked.select(
                "conv_id", "size", F.when(owned, F.col("low")).otherwise(F.col("middle") + 1).alias("low"),
                F.when(owned, F.col("middle")).otherwise(F.col("high")).alias("high"), F.when(owned, F.col("parent")).otherwise(F.col("owner")).alias("parent"),
            )
        )
        done.append(state.where("low = high"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return scratch.save(out.select("conv_id", F.col("low").alias("top"), "size", "parent"))


def _totals(chains: DataFrame, minima: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, leaves and saved of the subtree below the top of each chain, by doubling."""
    hung = chains.where("parent is not null").select(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("size")).distinct()
    own = minima.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("weight").alias("saved"))
    ends = chains.join(hung.withColumn("hung", F.lit(True)), ["conv_id", "size"], "left").join(own, "conv_id", "left")
    sums = ends.select("conv_id", F.col("parent").alias("above"), F.when(F.col("hung"), 0).otherwise(1).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    sums = scratch.save(sums)
    while not sums.where("above is not null").isEmpty():
        below = sums.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        grown = sums.join(below, "conv_id", "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")})
        grown = grown.select("conv_id", "above", "leaves", "saved")
        hops = sums.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        live = grown.where("above is not null").join(hops, "above").select("conv_id", F.col("next").alias("above"), "leaves", "saved")
        sums = scratch.save(live.unionByName(grown.where("above is null")))
    return sums.drop("above")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and conv_id: the ids of a node, CHUNK at a time, joined by commas."""
    at, held = None, []

    def give() -> pa.RecordBatch:
        data = ",".join(map(str, held)).encode()
        return pa.RecordBatch.from_arrays([longs([at[0]]), longs([at[1]]), longs([held[0]]), pa.array([data], pa.binary())], ["owner", "place", "first", "ids"])

    for batch in batches:
        for owner, place, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "place", "conv_id")), strict=True):
            if held and (at != (owner, place) or len(held) >= CHUNK):
                yield give()
                held = []
            at = (owner, place)
            held.append(conv)
    if held:
        yield give()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks sorted by node and first id: the node's hash."""
    at, sha = None, None
    names = ["owner", "place", "ends_sha256"]
    for batch in batches:
        out: list[tuple] = []
        for owner, place, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "place", "ids")), strict=True):
            if at != (owner, place):
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (owner, place), hashlib.sha256(ids)
            else:
                sha.update(b"," + ids)
        if out:
            yield pa.RecordBatch.from_arrays([longs([r[0] for r in out]), longs([r[1] for r in out]), pa.array([r[2] for r in out])], names)
    if at is not None:
        yield pa.RecordBatch.from_arrays([longs([at[0]]), longs([at[1]]), pa.array([sha.hexdigest()])], names)


def _ended(chains: DataFrame) -> DataFrame:
    """owner, place, ends_sha256 of every node at which conversations end."""
    ends = chains.select(F.expr("if(top <= size, conv_id, parent)").alias("owner"), F.col("size").alias("place"), "conv_id")
    order = ["owner", "place", "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(_chunked), "owner long, place long, first long, ids binary")
    chunks = chunks.repartition("owner", "place").sortWithinPartitions("owner", "place", "first")
    return chunks.mapInArrow(tidied(_hashed), "owner long, place long, ends_sha256 string")


def trie(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, place (from 1, without gaps; null: only says that the conversation is there), key and chars.
    saved_tokens: over the subtree, the code points of a node's last text once for each member beyond the first.
    """
    ids = scratch.save(turns.select("conv_id").distinct())
    first = ids.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    spark = turns.sparkSession
    mixed = [F.xxhash64(F.lit(i), "place", "key").alias(f"x{i}") for i in (1, 2)]
    rows = turns.where("place is not null").select("conv_id", "place", "chars", *mixed)
    prefixes = scratch.save(running(rows.withColumnRenamed("place", "at"), "conv_id", ["at"], scratch, xors=("x1", "x2")).drop("at"))
    minima = prefixes.groupBy("place", "x1", "x2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    minima = scratch.save(minima.withColumn("weight", F.expr("(n_convs - 1) * chars")))
    root = [(0, first.least, first.n, 0)] if first.n else []
    nodes = minima.select("place", "owner", "n_convs", "weight").unionByName(spark.createDataFrame(root, "place long, owner long, n_convs long, weight long"))
    found = _searched(ids, prefixes, minima, first.least or 0, scratch)
    chains = found.where("top <= size")
    sums = _totals(chains, minima, scratch)
    hung = chains.where("parent is not null").join(sums, "conv_id").select(F.col("parent").alias("owner"), (F.col("top") - 1).alias("place"), "leaves", "saved")
    hung = hung.groupBy("owner", "place").agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = chains.select(F.col("conv_id").alias("owner"), F.col("top").alias("place"), "parent", F.lit(True).alias("is_top"))
    ends = chains.select(F.col("conv_id").alias("owner"), F.col("size").alias("place"), F.lit(True).alias("is_end"))
    marks = hung.unionByName(tops, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True).groupBy("owner", "place")
    marks = marks.agg(*(F.max(c).alias(c) for c in ("hung", "leaves", "saved", "parent", "is_top", "is_end")))
    at = nodes.join(marks, ["owner", "place"], "left").selectExpr(
        "owner", "place", "-place as up", "n_convs", "if(is_top, parent, owner) as parent_conv_id",
        "coalesce(hung, 0L) + if(is_end, 0L, 1L) as n_children",
        "coalesce(leaves, 0L) + if(is_end and hung is null, 1L, 0L) as n_leaves", "weight + coalesce(saved, 0L) as saved_tokens",
    )
    at = at.withColumnRenamed("place", "depth")
    at = running(at, "owner", ["up"], scratch, adds=("n_leaves", "saved_tokens")).drop("place", "up")
    ended = scratch.save(_ended(found)).withColumnRenamed("place", "depth")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    names = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return saved(at.join(ended, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), *names, digest))


def prefix_trie(convs: DataFrame, shared_heads: bool = False) -> DataFrame:
    """``trie`` of a table with conv_id, turn, role and text; ``shared_heads``: of its conversations ``rebuilt``."""
    with Scratch(prepared(convs.sparkSession), "trie") as scratch:
        turns = scratch.save(placed(convs, scratch))
        return trie(rebuilt(turns, scratch) if shared_heads else turns, scratch)
