"""Scoring, configuration, profile and item functions on single values."""

from __future__ import annotations

import hashlib
import json
import random
import time
import unicodedata
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalmill.functions import config as cf
from evalmill.functions import points, stats, unicode
from evalmill.functions import profiles as pf
from evalmill.functions import scoring as sc
from evalmill.operators import canary, items, langmodel, scorers
from evalmill.sources import store


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("token", "want"),
    [("1,234", [1.234, 1234]), ("1.234", [1.234, 1234]), ("1,234.5", [1234.5]), ("1.234,5", [1234.5]), ("12,5", [12.5]), ("18.", [18]), ("-1,000", [-1000, -1]),
     ("1,234,567", [1234567]), ("12,34,56", []), (",", []), ("২৪", [24])],
)
def test_numbers(spark, token, want):
    assert sorted(value(spark, sc.number_interpretations(F.lit(token)))) == sorted(map(float, want))


@pytest.mark.parametrize(
    ("text", "want"),
    [("so\n#### Paris", "Paris"), ("a #### one #### two", "two"), ("a #### one ####", "one"), ("#### <308>", "308"), ("no marker", "no marker"),
     ("#### <exact answer span>308####", "308"), ("####", ""), ("", "")],
)
def test_span(spark, text, want):
    assert value(spark, sc.extract_span(F.lit(text))) == want


@pytest.mark.parametrize(
    ("text", "want"), [("It is four. More. #### 4", "It is four."), ("এটি চার। আরও", "এটি চার।"), ("no end\nsecond", "no end"), ("3.5 is it #### 1", "3.5 is it")]
)
def test_first_sentence(spark, text, want):
    assert value(spark, sc.first_sentence(F.lit(text))) == want


@pytest.mark.parametrize(
    ("pred", "gold", "lang", "want"),
    [("gave up 308 points", "308", "en", True), ("245", "24", "en", False), ("24h", "24", "en", False), ("the Answer!", "an answer", "en", True), ("北京市", "北 京", "zh", True),
     ("x", "", "en", False), ("", "x", "en", False), ("a+b (c)", "b (c", "fr", True)],
)
def test_containment(spark, pred, gold, lang, want):
    assert value(spark, sc.containment(F.lit(pred), F.array(F.lit(gold)), F.lit(lang))) is want


@pytest.mark.parametrize(
    ("pred", "gold", "want"), [("the cat sat", "cat", 2 / 3), ("", "", 1.0), ("", "x", 0.0), ("a b b", "b b c", 0.8), ("same words", "same words", 1.0)]
)
def test_f1(spark, pred, gold, want):
    assert value(spark, sc.f1(F.lit(pred), F.array(F.lit(gold)), F.lit("en"))) == pytest.approx(want)


def test_f1_without_golds_is_null(spark):
    assert value(spark, sc.f1(F.lit("x"), F.array().cast("array<string>"), F.lit("en"))) is None


def test_marker_only_does_not_fall_back(spark):
    args = F.lit("Paris is it"), F.array(F.lit("Paris")), F.lit("en")
    assert value(spark, sc.containment_lenient(*args)) is True
    assert value(spark, sc.containment_marker_only(*args)) is False


def test_strict_config(spark):
    assert value(spark, cf.parse(F.lit("snapkv@r0.75:wq167"), strict=True)).wq_c == 167
    with pytest.raises(PySparkException):
        value(spark, cf.parse(F.lit("nope@r0.75"), strict=True))


@pytest.mark.parametrize(
    ("config", "prefill", "size", "want"),
    [("baseline", 500, 500, None), ("snapkv@r0.75", 64, 0, 0.0), ("snapkv@r0.75", 65, 0, 0.75), ("snapkv@r0.75:w128", 128, 0, 0.0), ("snapkv@r0.75:w128", 129, 0, 0.75),
     ("h2o@b100", 100, 0, 0.0), ("h2o@b100", 400, 0, 0.75), ("tova@bb100", 5, 400, 0.75), ("tova@bb100", 5, 100, 0.0), ("snapkv@r0.5:wq200", 220, 0, 0.0), ("snapkv@r0.5:wq200", 221, 0, 0.5)],
)
def test_effective_ratio(spark, config, prefill, size, want):
    assert value(spark, cf.effective_ratio(cf.parse(F.lit(config)), F.lit(prefill), F.lit(size), F.lit(20))) == want


def test_chrf(spark):
    df = spark.createDataFrame([("the same", "the same"), ("abc", "xyz"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(pf.chrf("a", "b")).collect()] == [pytest.approx(100.0), 0.0, 0.0, None]


def one_chrf(hyp: str, ref: str) -> float:
    h, r = "".join(hyp.split()), "".join(ref.split())
    shares = []
    for n in range(1, 7):
        a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (h, r))
        if a and b:
            shares.append(((a & b).total() / a.total(), (a & b).total() / b.total()))
    p, q = (sum(x) / len(shares) for x in zip(*shares, strict=True)) if shares else (0, 0)
    return 100 * 5 * p * q / (4 * p + q) if p + q else 0.0


def test_chrf_of_a_batch_is_that_of_each_pair(monkeypatch):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abé \u3000日 \n𝒳") for _ in range(rng.randrange(40)))
    pairs = [(text(), text()) for _ in range(300)] + [("ab", "ab"), ("", ""), (" ", "a"), ("aaaaaaa", "aaa")]
    want = [pytest.approx(one_chrf(*p)) for p in pairs]
    assert list(pf.chrf_of([a for a, _ in pairs], [b for _, b in pairs])) == want
    monkeypatch.setattr(points, "CHUNK", 50)
    got = pf.chrf.func(pd.Series([a for a, _ in pairs] + [None]), pd.Series([b for _, b in pairs] + ["x"]))
    assert got.tolist()[:-1] == want and got.isna().tolist() == [False] * len(pairs) + [True]


def test_letters_by_script(spark):
    texts = ["abc é", "Привет", "漢字ひらカナ", "สวัสดี", "Ω α", "Ա1", "ａ", None, "", "१२ नम"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(pf.letters("t").alias("n")).collect()]
    for t, n in zip(texts, got, strict=True):
        letters = [c for c in t or "" if c.isalpha()]
        want = Counter(next((c for p, c in pf.SCRIPTS if unicodedata.name(x).startswith(p)), "Other") for x in letters)
        assert {c: n[c] for c in pf.CLASSES if n[c]} == want and n["letters"] == len(letters)


@pytest.mark.parametrize(
    ("output", "gold", "want"),
    [("#### ２４ apples", "24 apples", True), ("#### ﬁnal", "final", True), ("#### cafe\u0301", "café", True), ("#### ½", "1⁄2", True), ("#### ২৪", "24", False), ("#### The Cafe\u0301!", "café", True)],
)
def test_scorers_normalize_unicode_first(spark, output, gold, want):
    df = spark.createDataFrame([(output, [gold], "en")], "output string, golds array<string>, lang string")
    score = scorers.score(df, "mrag").first().score
    assert (score.correct, score.em_strict) == (want, want) and (score.f1 == 1.0) is want
    assert value(spark, sc.containment_lenient(F.lit(output), F.array(F.lit(gold)), F.lit("en"))) is want


@pytest.mark.parametrize(("token", "want"), [("៤២", [42]), ("௪௨", [42]), ("𝟜𝟚", [42]), ("൧൦", [10]), ("٣٫٥", [])])
def test_digits_of_all_scripts(spark, token, want):
    assert value(spark, sc.number_interpretations(F.lit(token))) == list(map(float, want))


def test_normal_forms(spark):
    texts = ["２４ ﬁ", "cafe\u0301", "", "ascii", "한글", "ｶﾞ①½ℌ", "İ ſ", "\u0344 ẛ̣", "日本㌔", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    for form, f in (("NFKC", unicode.nfkc), ("NFC", unicode.nfc), ("NFD", unicode.nfd)):
        assert [r[0] for r in df.select(f(F.col("t"))).collect()] == [t if t is None else unicodedata.normalize(form, t) for t in texts]


def test_overlap_counts_repeats(spark):
    rng = random.Random(9)
    rows = [([rng.choice("abcd日") for _ in range(rng.randrange(n))], [rng.choice("abcd日e") for _ in range(rng.randrange(30))]) for n in (2, 9, 30) for _ in range(25)] + [([], []), (["a"], [])]
    got = [r[2] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", sc.overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [(Counter(a) & Counter(b)).total() for a, b in rows]
    long = [f"w{rng.randrange(3000)}" for _ in range(40_000)]
    df = spark.createDataFrame([(long[:20_000], long[20_000:])], "a array<string>, b array<string>").cache()
    df.select(sc.overlap(F.col("a"), F.col("b"))).first()
    start = time.time()
    assert df.select(sc.overlap(F.col("a"), F.col("b"))).first()[0] == (Counter(long[:20_000]) & Counter(long[20_000:])).total()
    assert time.time() - start < 2


@pytest.mark.parametrize(
    ("text", "want"),
    [("  It is four.  ", "It is four."), ("a\nb.  ", "a"), (" \n a b \n c", "a b "), ("x. \u200b y", "x."), ("x.\u200by", "x."), ("", ""), ("   ", ""), ("y" * 200, "y" * 160), ("one.\n\n#### two. three", "one.")],
)
def test_first_sentence_without_white_space_around(spark, text, want):
    assert value(spark, sc.first_sentence(F.lit(text))) == want


def test_language_model_tells_held_out_lines(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang is not null").select("doc_id", "lang", "text")
    judge = langmodel.judge_of(langmodel.train(docs.where("doc_id % 2 = 0").select(F.col("lang").alias("label"), "text")))
    rest = docs.where("doc_id % 2 = 1").collect()
    lines = [(r.lang, langmodel.bare(x)) for r in rest for x in r.text.splitlines() if len(langmodel.bare(x)) >= 30]
    labels, sure = judge([x for _, x in lines])
    known = [(lang == label) for (lang, _), label, s in zip(lines, labels, sure, strict=True) if s >= pf.MIN_CONFIDENCE]
    assert len(known) > 0.8 * len(lines) and sum(known) > 0.95 * len(known)
    got = langmodel.drift(docs.where("doc_id % 2 = 1"), "doc_id", "text", "lang", judge).agg(F.avg("drift"), F.count("drift")).first()
    assert got[0] < 0.05 and got[1] > 0


def test_drift_by_any_judge(spark):
    judge = lambda lines: (["en" if "the" in x else "de" for x in lines], np.array([0.5 if "maybe" in x else 0.9 for x in lines]))
    line = "the quick brown fox jumps over dogs again and"
    texts = [(1, f"{line}\n{'der schnelle braune fuchs springt ueber hunde'}", "en"), (2, line + " maybe", "en"), (3, "short", "en"), (4, line, None), (5, None, "en"), (6, "", "en"), (7, "123 \\textbf{x} " * 40, "en"), (8, line, "de"), (8, line, "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.drift if r.drift is None else round(r.drift, 3)) for r in langmodel.drift(docs, "doc_id", "text", "lang", judge).collect() if r.doc_id != 8)
    away, here = (sum(map(str.isalpha, x)) for x in ("der schnelle braune fuchs springt ueber hunde", line))
    assert got == [(1, round(away / (away + here), 3)), (2, None), (3, None), (4, None), (5, None), (6, None), (7, 1.0)]
    assert sorted(r.drift for r in langmodel.drift(docs.where("doc_id = 8"), "doc_id", "text", "lang", judge).collect()) == [0.0, 1.0]


def test_drift_of_greek_and_of_nothing(spark):
    def drift(t, code, script):
        counts = spark.createDataFrame([(t,)], "t string").select(pf.canonical_letters("t").alias("n"))
        return counts.select(pf.drift_by_script(F.col("n"), F.lit(code), F.lit(script))).first()[0]

    assert drift("Καλημέρα", "el", "Greek") == 0.0 and drift("", "el", "Greek") is None and drift(None, "el", "Greek") is None
    vietnamese = "Tiếng Việt là ngôn ngữ của người Việt và là ngôn ngữ chính thức tại Việt Nam"
    assert drift(vietnamese, "vi", "Latin") == drift(unicodedata.normalize("NFD", vietnamese), "vi", "Latin") == 0.0
    assert drift("1 2 3", "el", "Greek") is None
    assert drift("hello", "fr", "Latin") is None
    assert drift("hello there", "vi", "Latin") == 1.0


def test_sentences_have_the_line_of_their_paragraph(spark):
    text = "% note\nFirst is 5\\% here. It\ngoes on. Then (so) it ends! % No.\n\n\\begin{table}\nBest. All.\n\\end{table}\n\nLast one."
    got = [tuple(r) for r in value(spark, pf.sentences(F.lit(text)))]
    assert got == [(2, "First is 5\\% here."), (2, "It goes on."), (2, "Then (so) it ends!"), (9, "Last one.")]


@pytest.mark.parametrize(
    ("default", "treated", "anchor", "want"),
    [(-9, -9, False, "kill-shaped"), (-9, -5.5, False, None), (-9, -6, False, "kill-shaped"), (-5, -2.9, False, "closes"), (2, -3, False, "no damage"), (-4, -2, False, None),
     (None, 1, False, "no damage"), (0, -8, False, "kill-shaped"), (0, 3.1, True, "not flat"), (0, -3, True, None), (-9, -9, True, "not flat")],
)
def test_closure(spark, default, treated, anchor, want):
    assert value(spark, stats.closure(F.lit(default).cast("double"), F.lit(treated).cast("double"), F.lit(anchor))) == want


def test_stack_ids_do_not_collide(spark):
    of = lambda *kv: value(spark, store.stack_id(F.create_map(*map(F.lit, kv))))
    assert of("a", "1|b=2") != of("a", "1", "b", "2") and of("b", "2", "a", "1") == of("a", "1", "b", "2")
    assert of("b", 'x "y"', "a", "1") == hashlib.sha256(json.dumps({"a": "1", "b": 'x "y"'}, sort_keys=True).encode()).hexdigest()[:12]


def test_fill_goes_on_after_what_does_not_fit(spark):
    pool = F.array(*map(F.lit, (5, 9, 3, 2)))
    got = value(spark, items.fill(pool, F.lit(10), lambda x: x))
    assert (got.used, got.chosen) == (10, [5, 3, 2])


def test_patch_counts_are_checked(spark):
    patch = lambda old, n: F.array(F.struct(F.lit(old).alias("old"), F.lit("z").alias("new"), F.lit(n).alias("count")))
    assert value(spark, items.apply_patches(F.lit("a b a"), patch("a", 2))) == "z b z"
    with pytest.raises(PySparkException):
        value(spark, items.apply_patches(F.lit("a b a"), patch("a", 1)))


def test_new_tokens(spark):
    count = lambda ids: value(spark, items.new_tokens(F.array(*map(F.lit, ids)), 0))
    assert [count(x) for x in ((1, 2, 3), (1, 2, 0), (1, 2, 0, 0), (0, 1, 0), (0, 0))] == [3, 3, 3, 3, 1]


def test_chain():
    text = "<<16-3-4=9>> <<9*2=18>>"
    assert canary.holds(text, "18") and not canary.holds(text, "17") and not canary.holds("nothing", "1")
    assert not canary.holds("<<2**3=8>>", "8")
    old, new, was, now = canary.perturb("She has 16 eggs.", text, "18", "s")
    assert old == 16 and was == 18 and now == (new - 7) * 2
    assert canary.Chain("<<6/4=1.5>><<1.5*2=3>>").results()[-1] == 3


def test_ambiguous_chains_are_errors():
    # 6 is the number that changes and a result that changes another way
    with pytest.raises(canary.ChainError):
        canary.Chain("<<6*3=18>><<18-12=6>><<6+1=7>>").results(Fraction(6), Fraction(8))
    assert canary.Chain("<<6*2=12>><<12+1=13>>").results(Fraction(6), Fraction(8)) == [16, 17]
    assert canary.perturb("6 and 6 eggs", "<<6*2=12>>", "12", "s") is None and canary.perturb("12 eggs", "<<12*2=24>>", "24", "s") is None
    assert canary.perturb("9 and 1,250 eggs", "<<1,250/2=625>>", "625", "s")[0] == 1250


@pytest.mark.parametrize(
    ("text", "want"), [("has 1,000 men", "has 2,000 men"), ("has 1.000 men", "has 2.000 men"), ("1000 and 1000.", "2000 and 2000."), ("10000", None), ("1000.5", None)]
)
def test_substitute(text, want):
    assert canary.substitute(text, 1000, 2000) == want
