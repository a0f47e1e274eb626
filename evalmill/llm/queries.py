"""One query for each operator of this package, over its whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format as cf
from . import decontaminate as dc
from . import filter_audit as fa
from . import jaccard_join as jj
from . import language_id as li
from . import licenses as lc
from . import odd_sketch as od
from . import packing as pk
from . import prefix_trie as pt
from . import quality as qu
from . import secrets as se
from . import substring_dedup as sd
from . import url_filter as uf
from .base import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = se.digests(se.scan_secrets(table(spark, sf_dir, "documents"), need=["doc_id"]))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_entropy", "spans")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jj.join_similar(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {hard}), (-7L, 1L, 'assistant', {hard}) AS t(conv_id, turn, role, text)")
    return cf.read_back(cf.format_chats(turns.unionByName(more)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), need=["doc_id"])
    return dc.verdict(judged).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.pack(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.identify(table(spark, sf_dir, "documents"), keys=["doc_id", "lang", "source"])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return qu.judge_quality(docs, labels, need=["doc_id"])


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uf.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.prefix_trie(table(spark, sf_dir, "conversations"), shared_heads=True)


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan, op2_jaccard_join, op3_chat_format, op4_license_scan, op5_decontaminate, op6_packing, op7_substring_dedup, op8_language_id, op9_quality_rules,
        op10_url_filter, op11_filter_audit, op12_prefix_trie, op13_near_dedup,
    )
    return {f.__name__: f for f in every}
