"""Queries of the operators against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from conftest import assert_same

from evalmill.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_as_sql(spark, data, name):
    assert_same(queries.queries()[name](spark, data), oracles.oracle_sql()[name], data)


def test_pipeline(spark, data):
    import corpus_pipeline as cp
    from test_llm_operators import components_of, hits

    docs = spark.read.parquet(f"{data}/documents.parquet")
    source = docs.collect()
    kept = cp.language(spark, docs, data)
    assert kept.columns == docs.columns and kept.count() == len(source)
    groups = components_of([(r.doc_id, r.text) for r in source])
    kept = cp.near_dups(spark, docs, data)
    assert {r.doc_id for r in kept.collect()} == {i for i, g in groups.items() if i == g} and kept.columns == docs.columns
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = set()
    for r in source:
        n, hit, _ = hits(r.text, items)
        if not (hit and 20 * hit >= n):
            clean.add(r.doc_id)
    kept = cp.benchmark(spark, docs, data)
    assert {r.doc_id for r in kept.collect()} == clean and kept.columns == docs.columns
    kept = cp.clean_secrets(spark, docs, data)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    from evalmill.llm.secrets import Scanner

    assert not any(Scanner().base(r.text) for r in kept.collect())
    want = {i for i in clean if i == groups[i]}
    got = cp.run(spark, data).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} <= want and len(got) > 0.9 * len(want)


def test_pipeline_keeps_one_row_a_group_and_all_columns(spark, data):
    import corpus_pipeline as cp

    prose = [" ".join(f"word{(i * 7 + j * j) % 91} letter" for j in range(60)) for i in range(4)]
    rows = [(1, prose[0], "en"), (1, prose[0], "en"), (2, prose[0] + " end", "en"), (3, prose[1], "en"), (None, prose[1], "en"), (None, prose[2], "en"), (None, prose[2], "en"), (5, None, "en"), (6, "", None), (7, prose[3], "en")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), "clash", "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, language string, items string")
    kept = cp.near_dups(spark, docs, data).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None and r.text) == [(1, prose[0]), (3, prose[1]), (7, prose[3])]
    assert [r.text for r in kept if r.doc_id is None] == [prose[2]] and {r.doc_id for r in kept if not r.text} == {5, 6}
    for stage in (cp.language, cp.near_dups, cp.benchmark, cp.clean_secrets):
        out = stage(spark, docs, data)
        assert out.schema.simpleString() == docs.schema.simpleString() and {r.language for r in out.collect()} <= {"clash"}
        assert stage(spark, docs.limit(0), data).count() == 0
    assert {r.doc_id for r in cp.language(spark, docs, data).collect()} == {1, 2, 3, 7, None}
    packed = cp.pack(spark, docs, data)
    assert packed.agg({"doc_tokens": "max"}).first()[0] > 100 and cp.pack(spark, docs.limit(0), data).count() == 0


def test_near_dups_deals_out_only_what_may_stay(spark, data, monkeypatch):
    """Where most documents go, their texts are not dealt out: all but a few are told from those that stay by two filters."""
    import corpus_pipeline as cp

    rows = [(i, f"group {i % 40} " + " ".join(f"w{i % 40}x{j}" for j in range(60)) + f" {i // 40}", "en") for i in range(2000)]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in [*rows, rows[3]]], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    dealt = []

    def counted(*args):
        some, rest = sieve(*args)
        dealt.append(some.count() if "_key" in some.columns else None)
        return some, rest

    sieve = cp.sieved
    monkeypatch.setattr(cp, "sieved", counted)
    kept = cp.near_dups(spark, docs, data)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [r[:2] for r in rows[:40]]
    assert [n for n in dealt if n is not None][-1] < 100


def test_native_plans_have_no_python(spark, data):
    for name in ("op3_chat_format", "op10_url_filter"):
        plan = queries.queries()[name](spark, data)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "ExternalRDD" not in plan
