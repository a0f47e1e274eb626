"""License scans by diagonal voting.

All rolling hashes of ``K`` words are joined with the places of the same hashes in the templates.  A meeting of
document place p and template place q votes for the diagonal p - q, where the template would begin.  Votes are counted
by template and diagonal; diagonals that lie at most ``GAP`` apart join, so that inserted or missing words split no
notice; and a joined span is verified by the share of the template's hashes that it holds and by its length.
A base phrase stands wherever one diagonal holds all hashes of the phrase.

Templates are a fixed list, or the caller's; up to ``BROADCAST_ROWS`` hashes they go to every worker.  Null texts have
no words.  An empty table gives no rows; further columns play no part; texts of any length are hashed in bounded blocks.
  Every input row gives a row; rows with the same id and text give the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .base import longs, prepared, texts, tidied
from .words import ALNUM, blocks, kgrams, texts_of

K, GAP, LEAST, LONGEST = 3, 2, 0.6, 1.5
BROADCAST_ROWS = 100_000
# Base phrases and labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of well-known licenses, as lower-case words.
NOTICES = {
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
}
_HEADER = np.array([0x5EED0F0000C0FFEE], np.uint64)  # joins the row that each document has for itself


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    rows: list[tuple[int, int, str, bool, int, int]] = [(int(_HEADER.view(np.int64)[0]), -1, "", False, 1, 0)]
    for i, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        (block,) = blocks(pa.array([text]), ALNUM)
        grams = kgrams(block.hashes, K).view(np.int64).tolist()
        if not grams:
            raise ValueError(f"a template needs {K} words or more: {text!r}")
        rows += [(g, i, label, i < len(phrases), len(grams), q) for q, g in enumerate(grams)]
    out = spark.createDataFrame(rows, "gram long, template int, label string, base boolean, grams int, at int")
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, place, gram, n_words: a row for each document and for each of its hashes."""
    for batch in batches:
        ids = batch.column("doc_id")
        body = texts_of(batch.column("text"))
        keys = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in body.to_pylist()), np.uint64, len(body))
        for block in blocks(body, ALNUM):
            inside = np.flatnonzero(block.inside(K))
            owner = block.owner()[inside]
            n = len(block.sizes)
            row = np.concatenate([np.arange(n), owner]) + block.rows.start
            place = np.concatenate([np.full(n, -1), inside - block.first[owner]])
            gram = np.concatenate([np.repeat(_HEADER, n), kgrams(block.hashes, K)[inside]])
            size = np.concatenate([block.sizes, np.zeros(len(inside), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), longs(keys[row]), longs(place), longs(gram), longs(size)],
                ["doc_id", "text_hash", "place", "gram", "n_words"],
            )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, first word, end word and share of the template, of every verified span.  score: the largest share,
    1 for a base phrase, 0 without a span.
    """
    spark = prepared(docs.sparkSession)
    schema = "doc_id long, text_hash long, place long, gram long, n_words long"
    key = ["doc_id", "text_hash"]
    votes = (
        texts(docs, id_col, text_col)
        .mapInArrow(tidied(_grams), schema)
        .join(_templates(spark, phrases, notices), "gram")
        .withColumn("diagonal", F.when(F.col("template") >= 0, F.col("place") - F.col("at")))
        .repartition(*key)
        .groupBy(*key, "template", "label", "base", "grams", "diagonal")
        .agg(
            F.count("*").alias("votes"),
            F.max("n_words").alias("n_words"),
            F.min("place").alias("first"),
            F.max("place").alias("last"),
            F.collect_set("at").alias("at"),
        )
    )
    line = W.Window.partitionBy(*key, "template", "label", "base", "grams").orderBy("diagonal")
    joined = (
        votes.withColumn("step", F.col("diagonal") - F.lag("diagonal").over(line))
        .withColumn("run", F.sum(F.when(F.col("step") <= GAP, 0).otherwise(1)).over(line.rowsBetween(W.Window.unboundedPreceding, 0)))
        .withColumn("exact", F.col("base") & (F.size("at") == F.col("grams")))
        .groupBy(*key, "template", "label", "base", "grams", "run")
        .agg(
            F.sum("votes").alias("votes"),
            F.max("n_words").alias("n_words"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("held"),
            F.sum(F.col("exact").cast("long")).alias("n_exact"),
            F.min(F.when(F.col("exact"), F.col("diagonal"))).alias("first_exact"),
            F.max(F.when(F.col("exact"), F.col("diagonal"))).alias("last_exact"),
        )
        .withColumn("share", F.least(F.lit(1.0), F.col("held") / F.col("grams")))
        .withColumn("end", F.col("last") + K)
    )
    good = (
        (F.col("template") >= 0)
        & ~F.col("base")
        & (F.col("share") >= LEAST)
        & (F.col("end") - F.col("first") <= LONGEST * (F.col("grams") + K - 1) + GAP)
    )
    exact = F.col("n_exact") > 0
    span = F.struct("label", "first", "end", "share")
    found = joined.groupBy(*key).agg(
        F.max(F.when(F.col("template") < 0, F.col("votes"))).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum("n_exact"), F.lit(0)).alias("n_base"),
        F.min("first_exact").alias("first_word"),
        F.max("last_exact").alias("last_word"),
        F.collect_set(F.when(exact, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(exact | good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(exact, F.lit(1.0)).when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, span))).alias("spans"),
    )
    # equal rows voted together, on the same diagonals; each gets its own row back
    return (
        found.withColumn("_copy", F.explode(F.expr("array_repeat(1, int(copies))")))
        .withColumn("n_base", F.col("n_base").cast("long"))
        .withColumn("base_labels", F.array_join(F.array_sort("base_labels"), ","))
        .withColumn("labels", F.array_join(F.array_sort("labels"), ","))
        .drop("_copy", "copies", "text_hash")
    )
