from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.streaming import ingest


def test_stream_gives_what_a_batch_gives_and_resumes(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = spark.range(50).select(F.format_string("k%d", F.col("id") % 20).alias("run_key"), F.timestamp_seconds(F.col("id")).alias("created_at"), "id")
    rows.where("id < 30").coalesce(1).write.parquet(source)

    def run() -> None:
        stream = ingest.first_of_key(ingest.read_rows(spark, source, rows.schema))
        assert ingest.append(stream, out, checkpoint).awaitTermination(60)

    run()
    assert spark.read.parquet(out).count() == 20
    rows.where("id >= 30").coalesce(1).write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out)
    assert got.count() == 20 and got.select("run_key").distinct().count() == 20
