"""Language ID by Bayesian evidence fusion.

Evidence: the words of the text (a multinomial of hashed words for each language, counted over all documents by their
declared language), the declared markup language, and a prior of the host.  The host's prior is smoothed
hierarchically: counts of a host are filled up with the distribution of its address suffix, and those with the
distribution over everything; all three come from grouped aggregation.  The posterior is the product, normalised.

The model knows every declared language.  Priors of up to ``SMALL_PRIORS`` values go to every worker.  Beyond that documents are joined with them by host: unless
the caller wants texts back these are short rows, and a host with a third of all documents is a join Spark can split.  A document is rejected when it has no words made of letters, or
when no language reaches ``least`` of the posterior.  Without any declared language all documents are rejected.

Null texts count as empty, null hosts share one prior, a null declared language gives no evidence.  Rows are judged each
by itself, so rows that repeat give the same; of languages with the same posterior the first by name is taken.  Columns
with the names of new ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import annotate, longs, prepared, tidied
from .words import Rule, blocks, kgrams

LETTERS = Rule(bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)), lower=True)
BUCKETS = 1 << 14
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 20.0
DECLARED_RIGHT = 0.9  # how often a declaration is taken to be right
EVIDENCE_WORDS = 50  # a long text counts as so many words, as words of one text depend on each other
LEAST = 0.5
UNKNOWN = "und"
SMALL_PRIORS = 640_000  # priors of hosts (a value for each language) up to so many values (5 MB) go to every worker


def _counts(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """Word buckets by language, over all documents with a declared language."""
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # of the languages that this worker meets
        for batch in batches:
            own = np.array([place.get(x, -1) for x in batch.column("declared").to_pylist()], np.int64)
            for block in blocks(batch.column("text"), LETTERS):
                lang = own[block.rows][block.owner()]
                bucket = (kgrams(block.hashes, 1) % np.uint64(BUCKETS)).astype(np.int64)
                order = np.argsort(lang, kind="stable")
                for x, i in zip(*np.unique(lang[order], return_index=True), strict=True):
                    if x >= 0:
                        some = bucket[order[i : i + int((lang == x).sum())]]
                        total[int(x)] = total.get(int(x), 0) + np.bincount(some, minlength=BUCKETS)
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([longs(at + x * BUCKETS), longs(n[at])], ["at", "n"])

    out = np.zeros(len(langs) * BUCKETS)
    rows = docs.mapInArrow(tidied(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():  # at most BUCKETS rows a language
        out[r.at] = r.n
    return out.reshape(len(langs), BUCKETS)


def _log_likelihoods(docs: DataFrame, langs: list[str]) -> DataFrame:
    """docs with n_letters_words and loglik (one value for each language)."""
    counts = _counts(docs, langs) + 0.5
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    # against the mean over languages, in integers, so that sums do not depend on the order of work
    sent = docs.sparkSession.sparkContext.broadcast(np.rint((logs - logs.mean(axis=0)) * (1 << 20)).astype(np.int32))
    fields = [T.StructField("n_letter_words", T.LongType()), T.StructField("loglik", T.ArrayType(T.DoubleType()))]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, values = [], []
        for block in blocks(batch.column("text"), LETTERS):
            bucket = (kgrams(block.hashes, 1) % np.uint64(BUCKETS)).astype(np.int64)
            n = block.sizes
            total = np.zeros((len(langs), len(n)), np.int64)
            for i, row in enumerate(sent.value):
                sums = np.concatenate([[0], np.cumsum(row[bucket], dtype=np.int64)])
                total[i] = sums[block.first[1:]] - sums[block.first[:-1]]
            values.append((total / (1 << 20) * np.minimum(1, EVIDENCE_WORDS / np.maximum(n, 1))).T)
            sizes.append(n)
        flat = np.concatenate(values)
        return [
            longs(np.concatenate(sizes)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(langs), pa.int32()), pa.array(flat.ravel())),
        ]

    return annotate(docs, fields, make, [c for c in docs.columns if c != "text"])


def _suffix(host: Column) -> Column:
    """The last label of a host name; a name without a dot is its own suffix without digits at its end."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.regexp_replace(host, "[0-9]+$", ""))


def _priors(docs: DataFrame, langs: list[str]) -> tuple[DataFrame, list[float]]:
    """host, prior (log, one value for each language); and the prior over everything."""
    known = docs.where(F.col("declared").isin(langs))
    hosts = known.groupBy("host", "declared").agg(F.count("*").alias("n"))
    suffixes = hosts.groupBy(_suffix(F.col("host")).alias("suffix"), "declared").agg(F.sum("n").alias("n"))
    totals = {r.declared: r.n for r in suffixes.groupBy("declared").agg(F.sum("n").alias("n")).collect()}  # a row a language
    share = [totals.get(x, 0) / max(1, sum(totals.values())) for x in langs]
    each = [F.sum(F.when(F.col("declared") == x, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, x in enumerate(langs)]

    def smooth(prefix: str, over: list[Column], weight: float) -> list[Column]:
        total = sum((F.col(f"{prefix}{i}") for i in range(len(langs))), F.lit(0.0))
        return [(F.col(f"{prefix}{i}") + weight * p) / (total + weight) for i, p in enumerate(over)]

    by_suffix = suffixes.groupBy("suffix").agg(*each)
    by_suffix = by_suffix.select("suffix", *(p.alias(f"s{i}") for i, p in enumerate(smooth("n", [F.lit(x) for x in share], SUFFIX_WEIGHT))))
    by_host = hosts.groupBy("host").agg(*each).withColumn("suffix", _suffix(F.col("host")))
    by_host = by_host.join(by_suffix, by_host["suffix"].eqNullSafe(by_suffix["suffix"]))
    prior = smooth("n", [F.col(f"s{i}") for i in range(len(langs))], HOST_WEIGHT)
    return by_host.select("host", F.array(*(F.log(p) for p in prior)).alias("prior")), share


def identify(
    docs: DataFrame,
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    keys: list[str] | None = None,
    least: float = LEAST,
) -> DataFrame:
    """``keys`` (all columns of ``docs`` unless given) with language, posterior, rejected and n_letter_words.

    Columns of ``docs`` with these names are replaced.
    """
    spark = prepared(docs.sparkSession)
    out = ["language", "posterior", "rejected", "n_letter_words"]
    keys = [c for c in (docs.columns if keys is None else keys) if c not in out]
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keys)).alias("row"),
        F.col(text_col).alias("text"),
        (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("declared"),
        (F.col(host_col) if host_col else F.lit(None)).cast("string").alias("host"),
    )
    langs = [r.declared for r in own.where("declared is not null").select("declared").distinct().collect()]
    if not langs:
        none = own.select("row.*", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("rejected"))
        return none.withColumn("n_letter_words", F.lit(0).cast("long"))
    langs.sort()
    scored = _log_likelihoods(own, langs)
    priors, share = _priors(own, langs)
    small = SMALL_PRIORS // len(langs)
    if priors.limit(small + 1).count() <= small:
        priors = F.broadcast(priors)
    scored = scored.join(priors.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host")), "left")
    overall = F.array(*(F.log(F.lit(max(x, 1e-9))) for x in share))
    names = F.array(*(F.lit(x) for x in langs))
    wrong = (1 - DECLARED_RIGHT) / max(1, len(langs) - 1)
    declared = F.transform(
        names, lambda x: F.when(~F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False)), 0.0)
        .when(x == F.col("declared"), F.log(F.lit(DECLARED_RIGHT))).otherwise(F.log(F.lit(wrong)) if wrong else 0.0)
    )
    logs = F.zip_with(
        F.zip_with("loglik", F.coalesce("prior", overall), lambda a, b: a + b), declared, lambda a, b: a + b
    )
    fused = scored.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    fused = fused.withColumn("posterior", F.round(1 / total, 9))
    best = F.element_at(names, F.array_position("logs", F.col("most")).cast("int"))
    rejected = (F.col("n_letter_words") == 0) | (F.col("posterior") < least)
    fused = fused.withColumn("rejected", rejected).withColumn("language", F.when(F.col("rejected"), F.lit(UNKNOWN)).otherwise(best))
    return fused.select("row.*", *out)
