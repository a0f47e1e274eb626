"""Printed statistics from printed counts."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from evalmill.functions import stats
from evalmill.operators.pairing import compared, paired_counts, with_interval
from evalmill.operators.regression import logits

# n, fixed, broken, lo, hi, verdict
INTERVALS = [
    (100, 2, 0, -1.4, 2.0, "non-inferior"), (100, 6, 8, -9.1, 5.9, "too wide"), (100, 6, 6, -6.9, 6.9, "too wide"), (100, 1, 2, -2.9, 2.4, "non-inferior"),
    (669, 19, 57, -7.8, -3.1, "certified residual"), (113, 6, 8, -8.0, 5.2, "too wide"), (669, 24, 93, -12.7, -7.4, "certified residual"),
    (669, 18, 70, -9.8, -5.2, "certified residual"), (669, 16, 39, -5.3, -1.2, "confirmed residual"), (669, 22, 56, -7.3, -2.4, "confirmed residual"),
    (100, 3, 18, -19.7, -5.7, "certified residual"), (100, 0, 8, -8.0, -2.1, "confirmed residual"), (669, 19, 154, -22.4, -17.3, "certified residual"),
    (100, 1, 0, -0.9, 1.0, "non-inferior"), (669, 25, 88, -11.9, -6.5, "certified residual"), (669, 16, 27, -3.5, 0.4, "too wide"),
]


def test_intervals(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(INTERVALS)], "i long, n long, fixed long, broken long")
    for r in with_interval(df).collect():
        _, _, _, lo, hi, verdict = INTERVALS[r.i]
        assert (round(r.lo, 1), round(r.hi, 1), r.verdict) == (lo, hi, verdict)


def test_mcnemar(spark):
    cases = {(5, 23): 0.00091, (117, 20): 7.157e-18, (55, 24): 0.00064, (3, 18): 0.00149, (0, 0): 1.0, (4, 4): 1.0, (1100, 1100): 1.0}
    df = spark.createDataFrame(list(cases), "b long, c long")
    for r in df.withColumn("p", stats.mcnemar_p(F.col("b"), F.col("c"))).collect():
        assert r.p == pytest.approx(cases[r.b, r.c], rel=5e-3)


def test_mcnemar_of_large_counts_does_not_vanish(spark):
    row = spark.createDataFrame([(1000, 1200)], "b long, c long").select(stats.mcnemar_p(F.col("b"), F.col("c"))).first()
    assert row[0] == pytest.approx(2.18e-5, rel=1e-2)


def test_fisher(spark):
    cases = {(51, 6, 560, 52): 0.62, (6, 50, 217, 396): 0.0001, (0, 0, 3, 4): 1.0, (3, 1, 1, 3): 0.4857142857, (8, 2, 1, 5): 0.03496503496}
    df = spark.createDataFrame(list(cases), "a long, b long, c long, d long")
    for r in df.withColumn("p", stats.fisher_p(*map(F.col, "abcd"))).collect():
        assert r.p == pytest.approx(cases[r.a, r.b, r.c, r.d], rel=2e-2, abs=5e-5)


def test_swapping_sides_negates_the_delta(spark):
    rows = [(c, i, (i * k) % 3 == 0) for c, k in (("a", 1), ("b", 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "config string, item_id long, correct boolean")
    one = compared(paired_counts(df, [], "a", ["b"])).first()
    two = compared(paired_counts(df, [], "b", ["a"])).first()
    assert (one.d, one.p, one.fixed) == (-two.d, two.p, two.broken)


def test_only_common_items_count(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 2, False), ("b", 3, True)], "config string, item_id long, correct boolean")
    assert paired_counts(df, [], "a", ["b"]).first().asDict() == {"config": "b", "n": 1, "n_base": 1, "n_comp": 0, "fixed": 0, "broken": 1}


def test_large_counts_cost_little():
    start = time.perf_counter()
    low, high = stats.interval(400_000, 1_000_000, 0.05)
    assert low == pytest.approx(0.3990396, abs=1e-7) and high == pytest.approx(0.4009610, abs=1e-7)
    assert stats.binomial_two_sided(499_000, 501_000) == pytest.approx(0.0456, abs=1e-4)
    assert stats.fisher_two_sided(300_000, 200_000, 299_000, 201_000) == pytest.approx(0.0415, abs=1e-4)
    assert time.perf_counter() - start < 1


def test_tails_are_sums_of_terms():
    rng = random.Random(1)
    for _ in range(300):
        a, b, c, d = (rng.randrange(rng.choice([2, 10, 60, 300])) for _ in range(4))
        n, row, col = a + b + c + d, a + b, a + c
        log = lambda x: math.lgamma(row + 1) - math.lgamma(x + 1) - math.lgamma(row - x + 1) + math.lgamma(n - row + 1) - math.lgamma(col - x + 1) - math.lgamma(n - row - col + x + 1)  # noqa: B023, E731
        every = [log(x) for x in range(max(0, row + col - n), min(row, col) + 1)]
        top = max(every)
        want = sum(math.exp(x - top) for x in every if x <= log(a) + 1e-9) / sum(math.exp(x - top) for x in every)
        assert stats.fisher_two_sided(a, b, c, d) == pytest.approx(want, rel=1e-7)
        p = sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b) * 2
        assert stats.binomial_two_sided(a, b) == pytest.approx(min(1.0, p), rel=1e-9)


def test_logits_are_maxima(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        x, z = rng.random(), rng.random()
        rows.append((float(rng.random() < 1 / (1 + math.exp(1 - 3 * x))), x, z, i // 4))
    df = spark.createDataFrame(rows, "y double, x double, z double, item long")
    got = {(r[0], r[1]): r for r in logits(df, "y", {"x": ["x"], "both": ["x", "z"]}, "item")}
    b0, b1 = got["x", "const"][2], got["x", "x"][2]
    p = [1 / (1 + math.exp(-b0 - b1 * x)) for _, x, _, _ in rows]
    assert sum(y - q for (y, *_), q in zip(rows, p, strict=True)) == pytest.approx(0, abs=1e-2)
    assert sum((y - q) * x for (y, x, *_), q in zip(rows, p, strict=True)) == pytest.approx(0, abs=1e-2)
    loglik = sum(math.log(q if y else 1 - q) for (y, *_), q in zip(rows, p, strict=True))
    assert got["x", "x"][6] == pytest.approx(loglik, abs=1e-4) and got["x", "x"][5] == pytest.approx(4 - 2 * loglik, abs=1e-4)
    assert got["both", "z"][6] >= loglik - 1e-6 and b1 > 1.5
