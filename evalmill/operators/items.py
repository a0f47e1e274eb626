"""Building items: pools, splits, packing under a budget, assembling prompts, patches, batches, token searches.

Random orders are orders by a hash of seed and key: the same everywhere, and stable when rows are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import ranks

POSITIONS = ("front", "middle", "back")
JOINER = "\n\n"


def shuffled(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def sample(df: DataFrame, n: int, seed: str, key: str, within: list[str] | None = None) -> DataFrame:
    """n rows of each group, or fewer where there are fewer; the first in the shuffled order."""
    part = W.Window.partitionBy(*(within or [F.lit(1)]))
    line = part.orderBy(shuffled(F.col(key), seed), key)
    return df.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= n).drop("_n")


def first_rows(df: DataFrame, n: int, order: str, within: list[str]) -> DataFrame:
    """The first n rows of each group; a larger n only adds rows."""
    line = W.Window.partitionBy(*within).orderBy(order)
    return df.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= n).drop("_n")


def fill(pool: Column, budget: Column, cost) -> Column:
    """Greedy fill of a budget from an array: what would go over is left out, and the rest is still tried.

    A struct of used and chosen.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(pool, 1, 0).alias("chosen"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + cost(x)
        return F.when(used > budget, s).otherwise(F.struct(used.cast("long").alias("used"), F.concat(s["chosen"], F.array(x)).alias("chosen")))

    return F.aggregate(pool, start, step)


def insert_at(passages: Column, gold: Column, position: Column) -> Column:
    n = F.size(passages)
    at = F.when(position == "front", 0).when(position == "middle", F.floor(n / 2).cast("int")).otherwise(n)
    return F.concat(F.slice(passages, F.lit(1), at), F.array(gold), F.slice(passages, at + 1, n - at))


def rotation(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, POSITIONS)), (F.pmod(i, F.lit(3)) + 1).cast("int"))


# The wrapper of the layout that puts the question in front of the passages.
REFINE = (
    "The original query is as follows: ",
    "\nWe have provided an existing answer: ",
    "\nWe have the opportunity to refine the existing answer (only if needed) with some more context below.\n------------\n",
    "\n------------\nGiven the new context, refine the original answer to better answer the query. "
    "If the context isn't useful, return the original answer.\nRefined Answer: ",
)
REFINE_ANSWER = "I do not yet have enough information to answer this question."
LAYOUTS = ("instr-last", "instr-first", "refine")


def assemble(layout: str, passages: Column, question: Column, instruction: Column) -> Column:
    body = F.array_join(passages, JOINER)
    if layout == "instr-last":
        return F.concat_ws(JOINER, body, question, instruction)
    if layout == "instr-first":
        return F.concat_ws(JOINER, instruction, body, question)
    if layout == "refine":
        a, b, c, d = map(F.lit, REFINE)
        return F.concat(a, question, b, F.lit(REFINE_ANSWER), c, body, d)
    raise ValueError(f"unknown layout: {layout}")


def pad(instruction: Column, filler: str, target: Column) -> Column:
    """The filler in front, as often as it takes to reach ``target`` words; the instruction stays last."""
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    unit = len(filler.split())
    times = F.greatest(F.lit(0), F.ceil((target - words(instruction)) / unit)).cast("int")
    return F.concat(F.repeat(F.lit(filler + " "), times), instruction)


def apply_patches(text: Column, patches: Column) -> Column:
    """Replaces each patch's old text in order; its number of occurrences in the text so far has to be as stated."""
    def step(t: Column, p: Column) -> Column:
        found = ((F.length(t) - F.length(F.replace(t, p["old"], F.lit("")))) / F.length(p["old"])).cast("int")
        wrong = F.raise_error(F.concat(F.lit("patch "), p["old"], F.lit(" occurs "), found.cast("string"), F.lit(" times"))).cast("string")
        return F.when(found == p["count"], F.replace(t, p["old"], p["new"])).otherwise(wrong)

    return F.aggregate(patches, text, step)


def truncate_at(text: Column, marker: str) -> Column:
    """What stands before the marker, without white space at its end; the marker has to occur just once."""
    found = (F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)
    before = F.regexp_replace(F.substring_index(text, marker, 1), r"\s+$", "")
    wrong = F.raise_error(F.concat(F.lit(f"marker {marker} occurs "), found.cast("int").cast("string"), F.lit(" times"))).cast("string")
    return F.when(found == 1, before).otherwise(wrong)


def annotations(text: Column) -> Column:
    """(expr, result) of every <<expr=result>>, without commas."""
    get = lambda i: F.transform(F.regexp_extract_all(text, F.lit("<<([^<>=]+)=([^<>=]+)>>"), i), lambda x: F.trim(F.replace(x, F.lit(","), F.lit(""))))
    return F.arrays_zip(get(1).alias("expr"), get(2).alias("result"))


def last_subsequence(hay: Column, needle: Column) -> Column:
    """Where an array last stands in another, from 0; null if nowhere."""
    n, m = F.size(hay), F.size(needle)
    starts = F.when((m > 0) & (m <= n), F.sequence(F.lit(0), n - m))
    return F.array_max(F.filter(starts, lambda i: F.slice(hay, i + 1, m) == needle))


def new_tokens(ids: Column, pad_id: int) -> Column:
    """Length without the padding at the end, of which the first token counts as the end token."""
    run = F.aggregate(
        F.reverse(ids), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, x: F.struct((s["n"] + F.when(s["on"] & (x == pad_id), 1).otherwise(0)).alias("n"), (s["on"] & (x == pad_id)).alias("on")),
    )["n"]
    return F.size(ids) - F.greatest(run - 1, F.lit(0))


def misaligned(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """n, n_off and first_off (a place from 1) over the places that both tables have, each in the order of its integer key."""
    place = lambda df, name: ranks.placed(df.select(F.col(key).alias(name)).withColumn("_v", F.floor(F.col(name) / ranks.SPAN)), [], "_v", name, "i").drop("_v")
    off = F.expr("a != b")
    return place(one, "a").join(place(two, "b"), "i").agg(F.count("*").alias("n"), F.count_if(off).alias("n_off"), F.min(F.when(off, F.col("i"))).alias("first_off"))


def aligned(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """``misaligned``, where a difference is an error."""
    got = misaligned(one, two, key)
    return got.where(F.assert_true(F.col("n_off") == 0, F.lit("the tables are not aligned")).isNull())


def batches(df: DataFrame, size: int, length: str, key: str, within: list[str]) -> DataFrame:
    """Batches of rows of similar length."""
    placed = ranks.placed(df, within, length, key, "batch")
    return placed.withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("long"))


def batch_size(kind: Column, size: int) -> Column:
    """Presses work on one prompt at a time."""
    return F.when(kind == "press", 1).otherwise(size)
