"""From documents to training sequences: five stages over everything the stage before has kept.

language    drops documents whose language cannot be told
near_dups   keeps one document of each group of near duplicates, that with the smallest id
benchmark   drops documents that hold benchmark passages (a word in twenty or more)
secrets     replaces secrets inside texts
packing     packs token ids into sequences; the result of the pipeline

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever further columns these
have.  Null texts count as empty: they have no letters, so the first stage drops them.  Rows with one id are one document,
of which one row stays, that with the least hash of its text; a null id stands for a document of its own text, so its
copies go too.  An empty table comes out empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm import decontaminate as dc
from evalmill.llm import jaccard_join, language_id, packing, secrets
from evalmill.llm.base import checkpoint_dir, removed, saved, sieved, table


def _renamed(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Columns that no operator's new ones can clash with, but for those that it reads."""
    return docs.toDF(*(c if c in keep else f"_c{i}" for i, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _renamed(docs, ("text", "lang", "source"))
    return language_id.identify(own).where("not rejected").select(*own.columns).toDF(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    unnamed = F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    keyed = _renamed(docs, ("doc_id", "text")).withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), unnamed))
    groups = jaccard_join.join_similar(keyed, id_col="_key", links=False)
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    again = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    # few documents have to be dealt out: the rest cannot be among those that go or come again, and of those that may be
    # among them, however many, only the ones that may stay are needed
    some, rest = sieved(keyed, "_key", gone.unionByName(again))
    stay = groups.where("doc_id = component_id").select("doc_id")
    some = sieved(some, "_key", sieved(stay, "doc_id", gone.unionByName(again))[0])[0]
    own = [c for c in keyed.columns if c != "_key"]
    first = F.struct(F.xxhash64("text"), F.to_json(F.struct(*own)))
    some = some.join(gone.toDF("_gone"), F.col("_key") == F.col("_gone"), "left_anti")
    some = some.groupBy("_key").agg(F.min_by(F.struct(*own), first).alias("row")).select("row.*")
    return rest.select(*own).unionByName(some).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _renamed(docs, ("text",))
    judged = dc.verdict(dc.decontaminate(own, table(spark, sf_dir, "benchmark")))
    return judged.where("not contaminated").select(*own.columns).toDF(*docs.columns)


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_dups", near_dups),
    ("benchmark", benchmark),
    ("secrets", clean_secrets),
    ("packing", pack),
]
ORACLE_SQL = None  # tokens, entropy windows and the language model have no SQL form; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each one's rows are written as Parquet and read again by the next, and a
    stage's folder goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if i:
            removed(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(path)
    packed = saved(STAGES[-1][1](spark, docs, sf_dir))
    removed(spark, folder)
    return packed
