"""Stand-ins for the result store, derived from the given tables alike in Spark and in SQL.

generations: a row for each document and configuration.  Whether it is correct depends on hashes of the item and of the
cell; the output is the document's whole text with an answer behind a marker, or, by another hash, without a marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.sources.tables import table

# configuration, share of correct items, window
CONFIGS = (
    ("baseline", 0.75, None),
    ("snapkv@r0.75", 0.60, 64),
    ("snapkv@r0.75:w32", 0.55, 32),
    ("snapkv@r0.75:w128", 0.70, 128),
    ("kv4", 0.72, None),
)
BASE = "baseline"
TREATMENTS = [c for c, _, _ in CONFIGS if c != BASE]
PRESSED = [c for c, _, w in CONFIGS if w]


def share(text: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("double") / 65536


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.regexp_extract("text", "[A-Za-z]{5,}", 0)
    answer = F.when(first == "", "answer").otherwise(F.lower(first))
    of_item = 0.7 * share(F.concat(F.lit("item:"), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", answer.alias("answer"), of_item.alias("of_item"))
    each = F.array(*(F.struct(F.lit(c).alias("config"), F.lit(t).alias("thr"), F.lit(w).cast("int").alias("w")) for c, t, w in CONFIGS))
    rows = docs.withColumn("c", F.explode(each)).select("*", "c.*").drop("c")
    of_cell = lambda tag: share(F.concat_ws(":", F.lit(tag), "config", F.col("doc_id").cast("string")))
    score = F.col("of_item") + 0.3 * of_cell("cell")
    said = F.when(F.col("correct"), F.col("answer")).otherwise(F.lit("zzz"))
    return (
        rows.withColumn("correct", score < F.col("thr"))
        .withColumn("output", F.concat("text", F.when(of_cell("mark") < 0.15, " ").otherwise("\n#### "), said))
        .select(
            "doc_id",
            F.lit("m4").alias("model"),
            F.lit("mrag").alias("task"),
            "lang",
            "config",
            "w",
            F.concat(F.lit("mrag-"), "lang", F.lit("-8k-"), F.col("doc_id").cast("string")).alias("item_id"),
            F.concat(F.lit("s"), F.pmod("doc_id", F.lit(2)).cast("string")).alias("stack_id"),
            F.concat(F.lit("store"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("store"),
            "source",
            "text",
            "output",
            "answer",
            "correct",
            (F.lit(20) + F.pmod(F.col("doc_id") * 7, F.lit(109))).cast("int").alias("n_output_tokens"),
            F.octet_length("output").alias("output_bytes"),
            F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit(None)).otherwise(of_cell("drift")).cast("double").alias("drift"),
            (F.lit(10) + F.pmod("doc_id", F.lit(25))).cast("int").alias("q_tokens"),
            (F.lit(40) + F.pmod("doc_id", F.lit(60))).cast("int").alias("c"),
            F.element_at(F.array(*map(F.lit, ("front", "middle", "back"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("position"),
        )
    )


def meta(rows: DataFrame) -> Column:
    return F.to_json(F.struct(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"), "position", "q_tokens"))


_SHARE = "(('0x' || substr(md5({0}), 1, 4))::INT / 65536.0)"
_VALUES = ", ".join(f"('{c}', {t}::DOUBLE, {w if w else 'NULL'}::INT)" for c, t, w in CONFIGS)
#: The same rows in SQL, as the first part of a WITH clause.
SQL = f"""WITH gen AS (
SELECT *, octet_length(encode(output)) AS output_bytes FROM (
SELECT *, text || CASE WHEN {_SHARE.format("'mark:' || config || ':' || doc_id")} < 0.15 THEN ' ' ELSE chr(10) || '#### ' END
  || CASE WHEN correct THEN answer ELSE 'zzz' END AS output
FROM (SELECT doc_id, 'm4' AS model, 'mrag' AS task, lang, config, w, 'mrag-' || lang || '-8k-' || doc_id AS item_id,
  's' || (doc_id % 2) AS stack_id, 'store' || (doc_id % 3) AS store, source, text,
  CASE WHEN regexp_extract(text, '[A-Za-z]{{5,}}') = '' THEN 'answer' ELSE lower(regexp_extract(text, '[A-Za-z]{{5,}}')) END AS answer,
  0.7::DOUBLE * {_SHARE.format("'item:' || doc_id")} + 0.3::DOUBLE * {_SHARE.format("'cell:' || config || ':' || doc_id")} < thr AS correct,
  (20 + (doc_id * 7) % 109)::INT AS n_output_tokens,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {_SHARE.format("'drift:' || config || ':' || doc_id")} END AS drift,
  (10 + doc_id % 25)::INT AS q_tokens, (40 + doc_id % 60)::INT AS c,
  ['front', 'middle', 'back'][(doc_id % 3 + 1)::INT] AS position
FROM documents, (VALUES {_VALUES}) AS v(config, thr, w))))
"""
