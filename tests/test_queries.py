"""Every query against its SQL, and those without any at least run."""

from __future__ import annotations

import pytest
from conftest import assert_same

from evalmill.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns


def _documents(folder, texts, lang="en"):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = len(texts)
    rows = {"doc_id": range(n), "text": texts, "lang": [lang] * n, "source": ["s"] * n, "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table({k: pa.array(list(v), None if k != "text" else pa.string()) for k, v in rows.items()}), f"{folder}/documents.parquet")
    return str(folder)


def test_candidates_are_printed_exactly(spark, tmp_path):
    """Numbers beyond 2 ** 53 and beyond doubles, halves that are none in binary, signed zeros, and no text."""
    texts = ["in all 356772239703934000123", "9" * 400, "-" + "9" * 400, "1.00005", "2.00005", "#### -0.000", "-0", "1e23 100000000000000000000000", "none", None]
    assert_same(QUERIES["extract_candidates"](spark, _documents(tmp_path, texts)), ORACLES["extract_candidates"], str(tmp_path))


def test_mcnemar_below_doubles(spark, tmp_path):
    folder = _documents(tmp_path, ["some text"] * 9000)
    got = QUERIES["mcnemar_exact"](spark, folder)
    assert_same(got, ORACLES["mcnemar_exact"], folder)
    assert got.where("log10_p = double('-infinity')").count() > 0


def test_unicode_forms_behind_texts_that_hold_golds(spark, tmp_path):
    texts = ["So 24 and 1 final café. And more", "#### 24", "1⁄2 <> ガ ####", "24 apples", "", None]
    assert_same(QUERIES["unicode_forms"](spark, _documents(tmp_path, texts)), ORACLES["unicode_forms"], str(tmp_path))


def test_every_document_gets_its_budgets_filled(spark, data, tmp_path):
    """Rows for documents without a benchmark item too, and for ids and texts that are null, come twice or fit nowhere."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    assert QUERIES["pack_token_budget"](spark, data).count() == 2 * spark.read.parquet(f"{data}/documents.parquet").count()
    rows = [(i, " ".join([f"w{i}"] * (7 * i % 90)), ("en", "de")[i % 2]) for i in range(150)]
    rows += [(3, "another text", "en"), (3, "another text", "en"), (3, rows[3][1], "en"), (200, None, "en"), (None, "no id", "en"), (None, "no id", None)]
    rows += [(201, "no language", None), (202, "x " * 300, None), (203, "a\x0bb\xa0c", ""), (204, "alone", "it"), (205, "too long " * 3000, "de")]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang"), map(list, zip(*rows, strict=True)), strict=True))), f"{tmp_path}/documents.parquet")
    asked = {"item_id": [3, 4, 4, 204, 999], "text": ["a question", "one", "two or three", None, "of none"]}
    pq.write_table(pa.table(asked), f"{tmp_path}/benchmark.parquet")
    got = QUERIES["pack_token_budget"](spark, str(tmp_path))
    assert_same(got, ORACLES["pack_token_budget"], str(tmp_path))
    assert got.count() == 2 * (len(rows) + 1)  # two items ask about document 4
