from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalmill.operators import building, items, scorers
from evalmill.sources import store, tables


def test_run_key(spark):
    got = spark.range(1).select(store.run_key(*map(F.lit, ("m", "t", "en", "baseline", "i1")))).first()[0]
    assert got == hashlib.sha256(b"m|t|en|baseline|i1|v1").hexdigest()[:24]


def test_stack_id_ignores_the_order_of_keys(spark):
    one = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    two = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    row = spark.range(1).select(store.stack_id(one).alias("x"), store.stack_id(two).alias("y")).first()
    assert row.x == row.y and len(row.x) == 12


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "run_key string, created_at long, v string")
    new = spark.createDataFrame([("b", 1, "z"), ("c", 2, "w")], old.schema)
    once = store.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 1, "z"), ("c", 2, "w")]
    assert sorted(map(tuple, store.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_insert_ignore_and_pending(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v long")
    new = spark.createDataFrame([("a", 2), ("b", 3)], old.schema)
    assert sorted(map(tuple, store.insert_ignore(old, new, "k").collect())) == [("a", 1), ("b", 3)]
    assert [r.k for r in store.pending(new, old, "k").collect()] == ["b"]


def test_snapshot(spark, tmp_path):
    df, path = spark.range(5).toDF("x"), str(tmp_path / "s")
    assert tables.snapshot(df, path, 5) == 5
    with pytest.raises(ValueError, match="5 rows"):
        tables.snapshot(df, path, 6)
    assert spark.read.parquet(path).count() == 5


def test_files(spark, tmp_path):
    from evalmill.schema import PERCENTILES

    (tmp_path / "q.json").write_text('[{"model": "m", "lang": "en", "n": 3, "Q50": 1, "Q90": 2, "Qmax": 3, "source": "s"}]')
    assert tables.json_array(spark, str(tmp_path / "q.json"), PERCENTILES).first().Q90 == 2
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "k long, line string")
    tables.write_lines(lines, str(tmp_path / "report"), "k")
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a", "b"]


def test_require(spark):
    assert store.require(spark.range(3), "id >= 0", "no").count() == 3
    with pytest.raises(Exception, match="negative"):
        store.require(spark.range(3), "id < 2", "negative").collect()


def test_scorers_by_task(spark):
    df = spark.createDataFrame([("so 5\n#### Paris", ["Paris"], "en")], "output string, golds array<string>, lang string")
    assert scorers.score(df, "mrag").first().score.correct is True
    assert scorers.score(df.withColumn("golds", F.array(F.lit("5"))), "mgsm").first().score.correct is True
    own = {"length": lambda o, g, x: F.struct((F.length(o) > 3).alias("correct"))}
    assert scorers.score(df, "length", own).first().score.correct is True
    with pytest.raises(ValueError):
        scorers.scorer_of("nope")


def test_layout_options_exclude_each_other():
    for bad in ({"name": "sideways"}, {"instruction_lang": "de", "pad": 9}, {"instruction_lang": "de", "name": "instr-first"}, {"name": "refine", "pad": 5}, {"name": "refine", "instruction_lang": "de"}):
        with pytest.raises(ValueError):
            building.Layout(**bad)


def test_budget_counts_all_parts_and_leaves_the_gold_out(spark):
    questions = spark.createDataFrame([(0, "en", "q q", "gold gold gold"), (1, "xx", "q", "g")], "item long, lang string, question string, gold string")
    pool = spark.createDataFrame([("en", i, " ".join(["w"] * i)) for i in range(1, 40)] + [("en", 99, "gold gold gold")], "lang string, slot long, text string")
    told = {"en": "do it", "xx": "x"}
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    rows = {at: {r.item: r for r in building.choose(questions, pool, [60], told, at_once=at).collect()} for at in (2, 64)}
    assert rows[2] == rows[64]
    r = rows[64][0]
    left, want = 60 - (3 + 2 + 2 + 6), []
    hashed = lambda text: int(hashlib.md5(f"evalmill:{text}".encode()).hexdigest()[:8], 16)
    for _, slot in sorted((hashed(i) ^ hashed("en:60:0"), i) for i in range(1, 40)):
        if slot + 2 <= left:
            left -= slot + 2
            want.append(slot)
    assert r.slots == want and r.used == 60 - left and rows[64][1].underfull and rows[64][1].slots == []
    doubled = building.choose(questions, pool, [60], told, tokens=lambda c: 2 * building.word_count(c)).where("item = 0").first()
    assert doubled.used > 2 * (3 + 2 + 2) and 99 not in doubled.slots
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == cached


def test_a_round_meets_a_bucket_a_question(spark, monkeypatch):
    """Greedy filling over a pool of many buckets, by brute force, and with a join in place of a broadcast."""
    rng = random.Random(4)
    questions = spark.createDataFrame([(i, "en", "q", "g") for i in range(12)], "item long, lang string, question string, gold string")
    costs = {i: rng.choice([1, 2, 3, 7, 30, 31, 60, 200]) for i in range(900)}
    pool = spark.createDataFrame([("en", i, " ".join([f"w{i}"] * n)) for i, n in costs.items()], "lang string, slot long, text string")
    hashed = lambda text: int(hashlib.md5(f"evalmill:{text}".encode()).hexdigest()[:8], 16)
    want = {}
    for item in range(12):
        for budget in (20, 700):
            left, slots = budget - (1 + 1 + 1 + 6), []
            for _, slot in sorted((hashed(i) ^ hashed(f"en:{budget}:{item}"), i) for i in costs):
                if costs[slot] + 2 <= left:
                    left -= costs[slot] + 2
                    slots.append(slot)
            want[item, budget] = (budget - left, slots)
    for few in (building.FEW_STEPS, 0):
        monkeypatch.setattr(building, "FEW_STEPS", few)
        got = building.choose(questions, pool, [20, 700], {"en": "x"}, at_once=8).collect()
        assert {(r.item, r.budget): (r.used, r.slots) for r in got} == want


def test_truncation_wants_one_marker(spark):
    cut = lambda t: spark.range(1).select(items.truncate_at(F.lit(t), "##")).first()[0]
    assert cut("a b \n ## c") == "a b"
    for bad in ("a", "a ## b ## c"):
        with pytest.raises(PySparkException):
            cut(bad)


def test_alignment(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "key long")
    assert tuple(items.misaligned(ids(1, 70000, 3), ids(3, 1, 70000), "key").first()) == (3, 0, None)
    assert tuple(items.misaligned(ids(1, 2, 3), ids(1, 3, 4), "key").first()) == (3, 2, 2)
    with pytest.raises(PySparkException):
        items.aligned(ids(1, 2, 3), ids(1, 3, 4), "key").collect()


def test_array_sink_and_console(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "a\n"), (2, None)], "x long, y string")
    tables.write_json(df, str(tmp_path / "a"))
    part = next((tmp_path / "a").glob("part-*")).read_text()
    assert json.loads(part) == [{"x": 1, "y": "a\n"}, {"x": 2}]
    assert sorted(map(tuple, tables.json_array(spark, str(tmp_path / "a"), df.schema).collect())) == [(1, "a\n"), (2, None)]
    with pytest.raises(ValueError):
        tables.write_json(df, str(tmp_path / "b"), most=1)
    assert tables.show_table(df.select("x")).split("\n") == ["x", "-", "1", "2"]
    told = []
    assert tables.union_stores({"a": df, "b": None}, told.append).count() == 2 and told == ["store b is missing"]
    df.write.parquet(str(tmp_path / "m" / "test-0.parquet"))
    assert tables.split(spark, str(tmp_path), "m", "test").count() == 2
