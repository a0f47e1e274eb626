"""The bucketed result store as batch and as stream sink, checked snapshots, and sources that fall silent."""

from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from evalmill.sources import store, tables
from evalmill.sources.result_store import PART, ResultStore
from evalmill.streaming import ingest

SCHEMA = "run_key string, v long, created_at timestamp, tags map<string,string>"


def rows_of(spark, ids, at=0):
    tags = F.create_map(F.lit("a"), F.col("id").cast("string"))
    return spark.createDataFrame([(i,) for i in ids], "id long").select(F.concat(F.lit("k"), "id").alias("run_key"), (F.col("id") + at).alias("v"), F.timestamp_seconds(F.lit(at)).alias("created_at"), tags.alias("tags"))


def opened(spark, path, buckets=8):
    return ResultStore(spark, str(path), rows_of(spark, [1]).schema, buckets=buckets)


def plain(df):
    return sorted((r.run_key, r.v, r.created_at) for r in df.collect())


def files(path) -> dict[str, float]:
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    rs = opened(spark, tmp_path / "s")
    assert rs.read().count() == 0 and rs.upsert(rows_of(spark, range(100)))
    before = files(tmp_path)
    new = rows_of(spark, [3, 200], at=5)
    touched = {r[0] for r in new.select(rs.part_of(F.col("run_key"))).collect()}
    rs.upsert(new)
    after = files(tmp_path)
    same = {p for p in before if after.get(p) == before[p]}
    assert len(before) == 8 and len(same) == 8 - len(touched) and not any(f"{PART}={b}/" in p for p in same for b in touched)
    assert plain(rs.read()) == plain(store.upsert(rows_of(spark, range(100)), new))
    assert not os.listdir(tmp_path / "s" / "staging")


def test_upsert_keeps_the_newest_and_of_equal_ones_the_later(spark, tmp_path):
    rs = opened(spark, tmp_path / "s")
    rs.upsert(rows_of(spark, [1, 2], at=5))
    rs.upsert(rows_of(spark, [1], at=4).union(rows_of(spark, [3], at=7)).union(rows_of(spark, [3], at=9)))
    rs.upsert(rows_of(spark, [2], at=5).withColumn("v", F.lit(77).cast("long")))
    assert [(k, v) for k, v, _ in plain(rs.read())] == [("k1", 6), ("k2", 77), ("k3", 12)]
    rs.upsert(rows_of(spark, [1], at=1).withColumn("created_at", F.lit(None).cast("timestamp")))
    rs.insert_ignore(rows_of(spark, [1, 4], at=99))
    assert [(k, v) for k, v, _ in plain(rs.read())] == [("k1", 6), ("k2", 77), ("k3", 12), ("k4", 103)]
    assert rs.read().where("run_key = 'k1'").first().tags == {"a": "1"}
    with pytest.raises(PySparkException, match="without a key"):
        rs.upsert(rows_of(spark, [5]).withColumn("run_key", F.lit(None).cast("string")))
    assert rs.read().count() == 4 and rs.upsert(rows_of(spark, [])) and rs.read().count() == 4


def test_joins_need_no_shuffle_of_the_store(spark, tmp_path):
    rs = opened(spark, tmp_path / "s")
    rs.upsert(rows_of(spark, range(50)))
    again = opened(spark, tmp_path / "s", buckets=3)  # keeps its own number
    assert again.buckets == 8
    plan = rows_of(spark, range(40, 60)).select("run_key", "v")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = again.pending(plan)
        text = left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.v for r in left.collect()) == list(range(50, 60))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("Exchange") == 1 and "Bucketed: true" in text


BREAKS = ["nothing staged", "staged", "one bucket moved", "moved", "in the ledger"]


@pytest.mark.parametrize("at", BREAKS)
def test_a_stream_killed_and_started_again_writes_every_batch_once(spark, tmp_path, monkeypatch, at):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    whole = [rows_of(spark, range(0, 40), at=1), rows_of(spark, range(20, 60), at=2), rows_of(spark, [5, 70], at=3)]
    for part in whole:
        part.coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    rs = opened(spark, tmp_path / "s")
    stream = lambda: ingest.read_rows(spark, source, whole[0].schema, files=1)
    calls = {"moves": 0, "on": True}
    real_move, real_stage, real_finish, real_mark = rs.files.move, rs._stage, rs._finish, rs.files.mark

    def broken(when: str, real):
        def call(*args):
            calls["moves"] += real is real_move
            if calls["on"] and at == when and len(rs.written()) == 1 and (real is not real_move or at != "one bucket moved" or calls["moves"] % 8 == 3):
                if when == "in the ledger":
                    real(*args)
                raise RuntimeError("killed")
            return real(*args)

        return call

    monkeypatch.setattr(rs, "_stage", broken("nothing staged", real_stage))
    monkeypatch.setattr(rs, "_finish", broken("staged", real_finish))
    monkeypatch.setattr(rs.files, "move", broken("one bucket moved", real_move))
    monkeypatch.setattr(rs.files, "mark", broken("in the ledger", real_mark) if at == "in the ledger" else broken("moved", real_mark))
    with pytest.raises(StreamingQueryException, match="killed"):
        rs.sink(stream(), checkpoint).awaitTermination(120)
    calls["on"] = False
    fresh = opened(spark, tmp_path / "s")
    fresh.sink(stream(), checkpoint).awaitTermination(120)
    assert fresh.written() == ["stream-0", "stream-1", "stream-2"]
    want = whole[0]
    for part in whole[1:]:
        want = store.upsert(want, part)
    assert plain(fresh.read()) == plain(want)
    assert not fresh.upsert(rows_of(spark, [999]), "stream-1") and fresh.read().where("run_key = 'k999'").isEmpty()


def test_a_snapshot_compares_content(spark, tmp_path, monkeypatch):
    df, path = rows_of(spark, range(5)), str(tmp_path / "s")
    assert tables.snapshot(df, path, 5) == 5
    sums = lambda d: d.agg(*tables.checksum({f.name: f.dataType for f in d.schema})).first()
    assert sums(df) == sums(df.orderBy(F.desc("v")).repartition(3)) and sums(df).n == 5
    for other in (df.withColumn("v", F.when(F.col("v") == 3, 4).otherwise(F.col("v"))), df.union(df.limit(1)), df.limit(4), df.withColumn("tags", F.create_map(F.lit("a"), F.lit("1")))):
        assert sums(other) != sums(df)
    nulls = spark.createDataFrame([(None, 1), (1, None)], "a long, b long")
    assert sums(nulls) != sums(spark.createDataFrame([(1, None), (1, None)], "a long, b long")) and sums(nulls.limit(0)).n == 0
    real = tables.checksum
    times = []

    def changed(columns):
        times.append(1)
        return real(columns)

    monkeypatch.setattr(tables, "checksum", changed)
    # one value changed between what was written and what is read again
    reader = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p: reader(self, *p).withColumn("v", F.when(F.col("v") == 3, 4).otherwise(F.col("v"))))
    with pytest.raises(ValueError, match="differs"):
        tables.snapshot(df, path, 5)
    monkeypatch.undo()
    assert times == [1] and plain(spark.read.parquet(path)) == plain(df) and not (tmp_path / "s.draft").exists()


def test_a_source_that_falls_silent_is_told_while_nothing_arrives(spark, tmp_path):
    source = str(tmp_path / "in")
    give = lambda *names: spark.createDataFrame([(n,) for n in names], "source string").withColumn("at", F.timestamp_seconds(F.lit(9))).coalesce(1).write.mode("append").parquet(source)
    give("a", "a", "b")
    stream = ingest.read_rows(spark, source, spark.read.parquet(source).schema)
    told = ingest.stalled(stream, "source", "at", 1500)
    query = told.writeStream.outputMode("update").format("memory").queryName("told").trigger(processingTime="300 milliseconds").start()
    try:
        seen = lambda: sorted((r.source, r.status, r.n) for r in spark.table("told").collect())

        def wait(rows):
            end = time.time() + 60
            while time.time() < end and seen() != rows:
                time.sleep(0.2)
            assert seen() == rows

        wait([("a", "silent", 2), ("b", "silent", 1)])
        give("b")
        wait([("a", "silent", 2), ("b", "back", 2), ("b", "silent", 1), ("b", "silent", 2)])
        assert spark.table("told").where("source = 'a'").first().last is not None
    finally:
        query.stop()


def test_sessions_end_when_later_data_come(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "source string, at timestamp"
    put = lambda rows: spark.createDataFrame(rows, "source string, s long").select("source", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(source)
    put([("a", 0), ("a", 50), ("a", 500), ("b", 10)])
    put([("a", 5000), ("b", 5000)])
    from pyspark.sql import types as T

    out = ingest.silences(ingest.read_rows(spark, source, T.StructType.fromDDL(schema), files=1), "source", "at", "100 seconds")
    ingest.append(out, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    got = sorted((r.source, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]
