"""The result store as stream sink and as bucketed table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.sources import store
from evalmill.sources.result_store import ResultStore
from evalmill.sources.shared import Files, shared_folder
from evalmill.sources.tables import table
from evalmill.streaming import ingest

from .registry import query
from .storing import NEW_ROWS
from .surrogate import CONFIGS


@contextmanager
def _opened(spark: SparkSession, schema, **options) -> Iterator[tuple[ResultStore, str]]:
    """A store in a new shared folder, which goes in the end."""
    folder = shared_folder(spark, "store")
    rs = ResultStore(spark, f"{folder}/rows", schema, **options)
    try:
        yield rs, folder
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {rs.table}")
        Files(spark, folder).delete(folder)


@query("SELECT user_id, event_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, upserted by a stream that writes each batch once."""
    columns = ["user_id", "event_id", "event_type", "value", "props"]
    schema = table(spark, sf_dir, "events").schema
    with _opened(spark, table(spark, sf_dir, "events").select(*columns).schema, key="user_id", order="event_id", buckets=8) as (rs, folder):
        # a pattern, as the table may be a file or a folder of files
        rows = ingest.read_rows(spark, f"{sf_dir}/events.parque[t]", schema)
        rs.sink(rows.select(*columns), f"{folder}/checkpoint").awaitTermination()
        return rs.read().checkpoint()


@query(f"SELECT doc_id, lang, n_chars, v FROM {NEW_ROWS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) = 1")
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a bucketed store, then those with a label once more; only their buckets are written again."""
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.lit(1).alias("v"))
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    new = old.join(labelled, "doc_id", "left_semi").select("doc_id", F.upper("lang").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"), F.lit(2).alias("v"))
    with _opened(spark, old.schema, key="doc_id", order="v", buckets=16) as (rs, _):
        rs.upsert(old, "first")
        rs.upsert(new, "labelled")
        rs.upsert(old.limit(0), "labelled")  # in the ledger already
        return rs.read().checkpoint()


_CONFIGS = ", ".join(f"('{c}')" for c, _, _ in CONFIGS)


@query(
    f"""WITH p AS (SELECT doc_id, lang, config, 'mrag-' || lang || '-8k-' || doc_id AS item_id,
substr(sha256(concat_ws('|', 'm4', 'mrag', lang, config, 'mrag-' || lang || '-8k-' || doc_id, 'v1')), 1, 24) AS run_key FROM documents, (VALUES {_CONFIGS}) v(config))
SELECT item_id, lang, config, run_key FROM p WHERE config <> 'kv4' OR doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def matrix_plan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration on every item, with the key of its row, less what the store has: of kv4, items with a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("mrag-"), "lang", F.lit("-8k-"), F.col("doc_id").cast("string")).alias("item_id"))
    plan = store.matrix_plan(docs, "m4", "mrag", [c for c, _, _ in CONFIGS])
    done = plan.where("config = 'kv4'").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    done = done.select("run_key", F.col("doc_id").alias("created_at"))
    with _opened(spark, done.schema, buckets=16) as (rs, _):
        rs.insert_ignore(done)
        return rs.pending(plan).select("item_id", "lang", "config", "run_key").checkpoint()
