from __future__ import annotations

import math
import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from evalmill.session import session

    folder = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{folder}/checkpoints", spark__sql__warehouse__dir=str(folder / "warehouse"),
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables in {DATA}")
    return DATA


def plain(value):
    """A value that compares alike from Spark and from DuckDB."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.8g}")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    return value


def assert_same(df, sql: str, folder: str) -> None:
    import duckdb

    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    key = lambda row: tuple((x is None, str(type(x)), str(x)) for x in row)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=key)
    ours = sorted((tuple(map(plain, r)) for r in df.collect()), key=key)
    assert ours == theirs
