"""Rows by their places in files, golds in every spelling, ledgers of repeats, batch sizes."""

from __future__ import annotations

import ast

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalmill.functions import golds
from evalmill.operators import items
from evalmill.plans.ledgers import ledger_totals
from evalmill.sources import aligned, store


def test_places_go_on_from_file_to_file(spark, tmp_path):
    want = []
    for i, n in enumerate((300, 1, 0, 700)):
        ids = list(range(1000 * i, 1000 * i + n))
        want += ids
        spark.createDataFrame([(x,) for x in ids], "id long").coalesce(1).write.parquet(str(tmp_path / "t" / f"part={i}"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k"):  # files whole, and cut into several tasks
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = aligned.numbered(spark, f"{tmp_path}/t/*").collect()
            assert [r.id for r in sorted(rows, key=lambda r: r.position)] == want and sorted(r.position for r in rows) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rows_at_one_place_are_kept_or_dropped_with_a_reason(spark):
    one = spark.createDataFrame([(i, float(i)) for i in range(5)], "position long, gold double")
    other = spark.createDataFrame([(0, 0.0), (1, 1.0000001), (2, None), (3, 9.0)], "position long, answer double")
    got = aligned.align(one, other, F.col("gold"), F.col("answer"))
    assert got.columns == ["position", "gold", "answer", "what"]
    assert [r.what for r in got.orderBy("position").collect()] == ["kept", "kept", "no gold", "mismatched", "unmatched"]


SPELLINGS = [
    '["a", "b\\"c", "é\\u00e9\\n"]', "['it\\'s', \"x 'y'\", 'a, b', '[c]']", "['a\\\\', 'b\\\\\\'c\\t\\x41']", "[]", "[ ]", "['a',]", "[1, -2, 3.50, 007, True, None]", "  plain scalar \n", "", "  ",
    "[broken", "['open]", "['a' 'b']", "[['nested']]", "(1, 2)", "[a, b]", "['日本', \"ü\"]", "['a',,'b']", "['two\nlines']", "['slash \\/ \\q']", "[1e3, 2.0]",
]


def told(s: str) -> list[str]:
    s = s.strip()
    if s.startswith("["):
        try:
            v = ast.literal_eval(s)
        except (SyntaxError, ValueError):
            v = None
        if isinstance(v, list) and not any(isinstance(x, list) for x in v):
            return [str(x) for x in v]
    return [s] if s else []


@pytest.mark.filterwarnings("ignore::SyntaxWarning")
def test_golds_are_read_as_python_reads_them(spark):
    spellings = [s for s in SPELLINGS if s != "[1, -2, 3.50, 007, True, None]"] + ["[1, -2, 3.50, True, None]"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spellings)], "i int, s string").orderBy("i")
    got = [r[0] for r in df.select(golds.decode_golds(F.col("s"))).collect()]
    want = [told(s) for s in spellings]
    loose = spellings.index("[1e3, 2.0]")  # doubles, as Spark prints them
    assert [float(x) for x in got[loose]] == [float(x) for x in want[loose]]
    juxtaposed = spellings.index("['a' 'b']")  # strings that stand side by side are no list here
    assert got[juxtaposed] == ["['a' 'b']"]
    assert [g for i, g in enumerate(got) if i not in (loose, juxtaposed)] == [w for i, w in enumerate(want) if i not in (loose, juxtaposed)]
    assert spark.range(1).select(golds.decode_golds(F.lit(None).cast("string"))).first()[0] == []


def test_ledger_totals(spark):
    rows = [(1, "k", "A", 0, "c", "x"), (2, "k", "B", 0, "c:w64", "x"), (3, "k", "B", 1, "c", "y"), (4, "l", "A", 0, "c", "z"), (5, "m", "A", 0, "c", "z"), (6, "m", "A", 0, "c", "z")]
    df = spark.createDataFrame(rows, "id long, k string, store string, stack int, cfg string, out string")
    got = {(r.total, r.store0, r.store, r.cross_stack, r.renamed): (r.shared, r.identical) for r in ledger_totals(df, "k", "id", "out").collect()}
    assert got == {
        ("pair", "A", "B", False, None): (1, 1), ("pair", "A", "B", True, None): (1, 0), ("pair", "A", "A", False, None): (1, 1), ("stack", None, None, False, None): (2, 2),
        ("stack", None, None, True, None): (1, 0), ("spelling", None, None, None, True): (1, 1), ("spelling", None, None, None, False): (2, 1), ("all", None, None, None, None): (3, 2),
    }


def test_presses_work_on_one_prompt_at_a_time(spark):
    df = spark.createDataFrame([("press",), ("kvquant",), ("baseline",)], "kind string")
    assert [r[0] for r in df.select(items.batch_size(F.col("kind"), 8)).collect()] == [1, 8, 8]


def test_a_pool_of_another_size_is_an_error(spark):
    pool = spark.range(7).agg(F.count("*").alias("n"))
    assert store.require(pool, "n = 7", "pool size").count() == 1
    with pytest.raises(PySparkException, match="pool size"):
        store.require(pool, "n = 8", "pool size").collect()


def test_matrix_plan_has_the_keys_of_rows(spark):
    questions = spark.createDataFrame([("i1", "en"), ("i2", "de")], "item_id string, lang string")
    plan = store.matrix_plan(questions, "m", "t", ["baseline", "kv4"])
    key = spark.range(1).select(store.run_key(*map(F.lit, ("m", "t", "de", "kv4", "i2")))).first()[0]
    assert plan.count() == 4 and plan.where("item_id = 'i2' and config = 'kv4'").first().run_key == key
