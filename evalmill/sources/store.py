"""The result store: keys, upserts, resuming, summaries and guards, on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_VERSION = "v1"


def run_key(*parts: Column, version: str = PROMPT_VERSION) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts, F.lit(version)), 256), 1, 24)


def canonical_json(description: Column) -> Column:
    """A map of strings as one JSON object, its keys in order; characters beyond ASCII stay as they are."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    ordered = F.array_sort(F.map_entries(description))
    pairs = F.transform(ordered, lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(F.coalesce(e["value"], F.lit("")))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def stack_id(description: Column) -> Column:
    """Of a map: the same whatever the order of its keys."""
    return F.substring(F.sha2(canonical_json(description), 256), 1, 12)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key (null is oldest); each worker goes down to a row a key before rows are dealt out."""
    every = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(every, F.struct(*order)).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "run_key", order: str = "created_at") -> DataFrame:
    """Old and new rows, the newest of each key; of rows with one key and time, a new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, order, "_new").drop("_new")


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def matrix_plan(questions: DataFrame, model: str, task: str, configs: list[str]) -> DataFrame:
    """Every configuration on every item (item_id and lang among its columns), with model, task and the key of the row."""
    every = questions.withColumns({"model": F.lit(model), "task": F.lit(task), "config": F.explode(F.array(*map(F.lit, configs)))})
    return every.withColumn("run_key", run_key(*map(F.col, ("model", "task", "lang", "config", "item_id"))))


def pending(plan: DataFrame, done: DataFrame, key: str = "run_key") -> DataFrame:
    """Planned work that has no row yet."""
    return plan.join(done.select(key), key, "left_anti")


def cell_summary(rows: DataFrame) -> DataFrame:
    """Rows, accuracy and mean sizes of every cell; a null drift stands for undecidable and does not count."""
    return rows.groupBy("model", "task", "lang", "config").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"),
        F.round(F.avg("n_output_tokens"), 9).alias("mean_tokens"),
        F.round(F.avg("output_bytes"), 9).alias("mean_bytes"),
        F.round(F.avg("drift"), 9).alias("mean_drift"),
    )


def manifest_check(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """store, want, got, ok: stores of the manifest against their counts."""
    got = rows.groupBy("store").agg(F.count("*").alias("got"))
    joined = manifest.join(got, "store", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return joined.select("store", "want", "got", (F.col("want") == F.col("got")).alias("ok"))


def require(df: DataFrame, condition: str, what: str) -> DataFrame:
    """The rows; a row against ``condition`` is an error."""
    return df.where(F.assert_true(F.expr(condition), F.lit(what)).isNull())
