"""Scoring of outputs, text profiles and documents' lint."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from evalmill.functions import profiles as pf
from evalmill.functions import scoring as sc
from evalmill.functions import unicode
from evalmill.operators import langmodel, ranks
from evalmill.sources.shared import shared_folder
from evalmill.sources.tables import table, write_lines

from .registry import query
from .surrogate import SQL, generations

# a number of every document in several writings
_THOUSANDS = "(n_chars // 1000) || '{0}' || lpad((n_chars % 1000)::VARCHAR, 3, '0')"
_TOKEN = (
    "CASE doc_id % 9 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN " + _THOUSANDS.format(",") + " WHEN 2 THEN " + _THOUSANDS.format(".") + " WHEN 3 THEN " + _THOUSANDS.format(",") + " || '.5'"
    " WHEN 4 THEN " + _THOUSANDS.format(".") + " || ',25' WHEN 5 THEN '-' || " + _THOUSANDS.format(",") + " || '.' WHEN 6 THEN n_chars || '.2,3,' WHEN 7 THEN n_chars || ',75' ELSE ',' END"
)


def _token() -> Column:
    n, rest = F.col("n_chars").cast("string"), F.lpad(F.pmod("n_chars", F.lit(1000)).cast("string"), 3, "0")
    head = F.floor(F.col("n_chars") / 1000).cast("string")
    grouped = lambda mark, after="", before="": F.concat(F.lit(before), head, F.lit(mark), rest, F.lit(after))
    writings = [n, grouped(","), grouped("."), grouped(",", ".5"), grouped(".", ",25"), grouped(",", ".", "-"), F.concat(n, F.lit(".2,3,")), F.concat(n, F.lit(",75")), F.lit(",")]
    return F.element_at(F.array(*writings), (F.pmod("doc_id", F.lit(9)) + 1).cast("int"))


# readings of a number token t, as a list of doubles, in order
_READ = r"""CASE WHEN NOT regexp_matches(t, '[0-9]') THEN []::DOUBLE[] WHEN contains(t, '.') AND contains(t, ',') THEN
  CASE WHEN length(t) - instr(reverse(t), '.') > length(t) - instr(reverse(t), ',') THEN list_filter([try_cast(replace(t, ',', '') AS DOUBLE)], lambda x: x IS NOT NULL)
  ELSE list_filter([try_cast(replace(replace(t, '.', ''), ',', '.') AS DOUBLE)], lambda x: x IS NOT NULL) END
 WHEN contains(t, '.') OR contains(t, ',') THEN list_sort(list_distinct(list_filter([
  CASE WHEN regexp_full_match(ltrim(t, '-'), '[0-9]{1,3}(\.[0-9]{3})+|[0-9]{1,3}(,[0-9]{3})+') THEN try_cast(replace(replace(t, '.', ''), ',', '') AS DOUBLE) END,
  CASE WHEN length(t) - length(replace(replace(t, '.', ''), ',', '')) = 1 THEN try_cast(replace(t, ',', '.') AS DOUBLE) END], lambda x: x IS NOT NULL)))
 ELSE list_filter([try_cast(t AS DOUBLE)], lambda x: x IS NOT NULL) END"""
_JOINED = "array_to_string(list_transform({0}, lambda x: printf('%.4f', x)), ' ')"
_LAST = r"""coalesce(CASE WHEN contains({0}, '####') THEN regexp_extract_all(string_split({0}, '####')[-1], '-?[0-9][0-9.,]*')[-1] END, regexp_extract_all({0}, '-?[0-9][0-9.,]*')[-1])"""


@F.pandas_udf(T.StringType())
def _printed(numbers: pd.Series) -> pd.Series:
    """Four decimals of each double's exact value, as C prints it; the JVM pads the shortest digits with zeros."""
    return numbers.map(lambda row: None if row is None else " ".join(f"{x:.4f}" for x in row))


def _joined(numbers: Column) -> Column:
    return _printed(F.array_sort(numbers))


@query(f"SELECT doc_id, token, {_JOINED.replace('{0}', _READ)} AS readings FROM (SELECT doc_id, token, rtrim(trim(token), '.,') AS t FROM (SELECT doc_id, {_TOKEN} AS token FROM documents))")
def number_interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _token().alias("token"))
    return rows.select("doc_id", "token", _joined(sc.number_interpretations(F.col("token"))).alias("readings"))


_CANDIDATES = f"SELECT *, coalesce({_READ}, []::DOUBLE[]) AS cand FROM (SELECT *, rtrim({_LAST.replace('{0}', 'body')}, '.,') AS t FROM {{0}})"


@query("SELECT doc_id, " + _JOINED.replace("{0}", "cand") + " AS candidates FROM (" + _CANDIDATES.replace("{0}", "(SELECT doc_id, text AS body FROM documents)") + ")")
def extract_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _joined(sc.extract_candidates(F.col("text"))).alias("candidates"))


_SAID = f"text || chr(10) || CASE doc_id % 4 WHEN 0 THEN '#### ' || {_TOKEN} WHEN 1 THEN 'in all ' || {_TOKEN} WHEN 2 THEN {_TOKEN} || ' #### none' ELSE '#### ' || doc_id END"


@query(
    "SELECT doc_id, len(list_filter(cand, lambda x: abs(x - gold::DOUBLE) <= 1e-6)) > 0 AS ok FROM ("
    + _CANDIDATES.replace("{0}", f"(SELECT doc_id, n_chars AS gold, {_SAID} AS body FROM documents)")
    + ")"
)
def numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the last number behind the marker, or else of all, the number of characters?  Digits are those of Bengali."""
    behind = [F.concat(F.lit("#### "), _token()), F.concat(F.lit("in all "), _token()), F.concat(_token(), F.lit(" #### none")), F.concat(F.lit("#### "), F.col("doc_id").cast("string"))]
    last = F.translate(F.element_at(F.array(*behind), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")), "0123456789", "০১২৩৪৫৬৭৮৯")
    gold = sc.parse_gold(F.format_number("n_chars", 0))
    return table(spark, sf_dir, "documents").select("doc_id", sc.numeric_match(F.concat("text", F.lit("\n"), last), gold).alias("ok"))


@query(
    SQL
    + r"SELECT item_id, config, len(regexp_extract_all(output, '\S+'))::INT AS n_output_tokens, octet_length(encode(output))::INT AS output_bytes, length(output)::INT AS output_chars FROM gen"
)
def output_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations(spark, sf_dir).select("item_id", "config", sc.output_stats(F.col("output")).alias("s")).select("item_id", "config", "s.*")


_ARTICLES = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sc.ARTICLES.items()) + " ELSE []::VARCHAR[] END"
_NORMAL = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[\p{P}\p{S}]', ' ', 'g'), '\s+'), lambda x: x <> '' AND NOT list_contains({1}, x)), ' ')".replace(
    "{1}", _ARTICLES
)


@query(f"SELECT doc_id, md5({_NORMAL.replace('{0}', 'text')}) AS normal_md5 FROM documents")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of every text; texts beyond ASCII go through NFKC first."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sc.normalize(F.col("text"), F.col("lang"))).alias("normal_md5"))


@query(
    f"""WITH n AS (SELECT doc_id, lang, {_NORMAL.replace('{0}', 'text')} AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(replace(t, ' ', '')) WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::BIGINT AS n_tokens FROM n"""
)
def lang_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text; even ids are taken for Thai, which goes by characters."""
    normal = sc.normalize(F.col("text"), F.col("lang"))
    lang = F.when(F.pmod("doc_id", F.lit(2)) == 0, "th").otherwise(F.lit("xx"))
    rows = table(spark, sf_dir, "documents").withColumn("t", normal)
    return rows.select("doc_id", F.size(sc.tokenize(F.col("t"), lang)).cast("long").alias("n_tokens"))


_SPAN = r"""coalesce(list_filter(list_transform(range(len(p) - 1, 0, -1), lambda i: trim(regexp_replace(regexp_replace(array_to_string(p[i + 1:], '####'), '[<>]', ' ', 'g'), '[#\s]+$', ''), chr(10) || ' ')),
 lambda r: regexp_matches(r, '[\p{L}\p{N}_]'))[1], CASE WHEN regexp_matches(output, '[\p{L}\p{N}_]') THEN trim(regexp_replace(regexp_replace(output, '[<>]', ' ', 'g'), '[#\s]+$', ''), chr(10) || ' ') END, '')"""
_FIRST = r"""CASE WHEN regexp_matches(prose, '^((?s).*?[.!?。！？؟।॥])[\s\x{200B}]') THEN regexp_extract(prose, '^((?s).*?[.!?。！？؟।॥])[\s\x{200B}]', 1)
 ELSE left(regexp_split_to_array(prose, '[\n\r]')[1], 160) END"""
SPANS = (
    SQL
    + f""", sp AS (SELECT *, {_SPAN} AS span, {_FIRST} AS first FROM (SELECT *, string_split(output, '####') AS p, trim(string_split(output, '####')[1], ' ' || chr(10) || chr(9) || chr(13)) AS prose FROM gen)),
nm AS (SELECT *, {_NORMAL.replace('{0}', 'span')} AS ns, {_NORMAL.replace('{0}', 'first')} AS nf, {_NORMAL.replace('{0}', 'answer')} AS ng FROM sp)
"""
)
_IN = r"(ng <> '' AND regexp_matches({0}, '(^|[^\p{L}\p{N}])' || ng || '([^\p{L}\p{N}]|$)'))"


@query(SPANS + "SELECT item_id, config, md5(span) AS span_md5 FROM sp")
def extract_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations(spark, sf_dir).select("item_id", "config", F.md5(sc.extract_span(F.col("output"))).alias("span_md5"))


@query(SPANS + "SELECT item_id, config, md5(first) AS first_md5 FROM sp")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations(spark, sf_dir).select("item_id", "config", F.md5(sc.first_sentence(F.col("output"))).alias("first_md5"))


def _scored(spark: SparkSession, sf_dir: str, name: str, score) -> DataFrame:
    args = F.col("output"), F.array("answer"), F.col("lang")
    return generations(spark, sf_dir).select("item_id", "config", score(*args).alias(name))


@query(SPANS + f"SELECT item_id, config, {_IN.replace('{0}', 'ns')} AS ok FROM nm")
def containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "ok", lambda o, g, x: sc.containment(sc.extract_span(o), g, x))


@query(SPANS + f"SELECT item_id, config, {_IN.replace('{0}', 'ns')} OR {_IN.replace('{0}', 'nf')} AS ok FROM nm")
def containment_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "ok", sc.containment_lenient)


@query(SPANS + f"SELECT item_id, config, len(p) > 1 AND {_IN.replace('{0}', 'ns')} AS ok FROM nm")
def containment_marker_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "ok", sc.containment_marker_only)


@query(SPANS + "SELECT item_id, config, ns = ng AS ok FROM nm")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "ok", lambda o, g, x: sc.exact_match(sc.extract_span(o), g, x))


# the gold is one token
_F1 = r"""CASE WHEN ns = '' AND ng = '' THEN 1.0 WHEN ns = '' OR ng = '' OR NOT list_contains(string_split(ns, ' '), ng) THEN 0.0 ELSE round(2.0 / (len(string_split(ns, ' ')) + 1), 9) END::DOUBLE"""


@query(SPANS + f"SELECT item_id, config, {_F1} AS f1 FROM nm")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "f1", lambda o, g, x: F.round(sc.f1(sc.extract_span(o), g, x), 9))


@query(SPANS + f"SELECT item_id, config, {_IN.replace('{0}', 'ns')} AS em, ns = ng AS em_strict, {_F1} AS f1 FROM nm")
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _scored(spark, sf_dir, "s", sc.span_scores)
    return got.select("item_id", "config", "s.em", "s.em_strict", F.round("s.f1", 9).alias("f1"))


@query(
    SPANS
    + r"SELECT item_id, config, CASE WHEN ng = '' THEN NULL WHEN list_contains(string_split(ns, ' '), ng) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM nm"
)
def gold_token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    def recall(o, g, x):
        return sc.gold_recall(sc.tokenize(sc.fold_spelling(sc.extract_span(o)), x), sc.tokenize(F.element_at(g, 1), x)).cast("double")

    return _scored(spark, sf_dir, "recall", recall)


# full-width letters and digits, accents as characters of their own, ligatures: forms that NFKC makes one
_PLAIN_FORM = "".join(chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum())
_WIDE_FORM = "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN_FORM)
_CASES = (("#### ２４ apples", "24 apples", True), ("#### ﬁnal", "final", True), ("#### café", "café", True), ("#### ½ of it", "1⁄2", True), ("#### ①", "1", True), ("#### ２４５", "24", False), ("#### ｶﾞ", "ガ", True))
_CASE_ROWS = ", ".join(f"('{o}', '{g}', {ok})" for o, g, ok in _CASES)
_MANY = rf"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(text, '\S+') AS w FROM documents),
n AS (SELECT doc_id, {_NORMAL.replace('{0}', "array_to_string(w[1:60], ' ')")} AS p, {_NORMAL.replace('{0}', "array_to_string(w[21:110], ' ')")} AS g FROM w),
t AS (SELECT doc_id, p, g, CASE WHEN p = '' THEN [] ELSE string_split(p, ' ') END AS a, CASE WHEN g = '' THEN [] ELSE string_split(g, ' ') END AS b FROM n),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS k FROM t)
"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, an output whose words are written full-width, and a gold of many words that overlaps it."""
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("w"))
    output = F.translate(F.array_join(F.slice("w", 1, 60), " "), _PLAIN_FORM, _WIDE_FORM)
    return rows.select("doc_id", "lang", output.alias("output"), F.array_join(F.slice("w", 21, 90), " ").alias("gold"))


@query(_MANY + "SELECT doc_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN k = 0 THEN 0.0 ELSE 2.0 * k / (len(a) + len(b)) END::DOUBLE, 9) AS f1 FROM c")
def token_f1_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 against golds of up to ninety words, repeats among them; outputs are full-width and go through NFKC."""
    return _wide(spark, sf_dir).select("doc_id", F.round(sc.f1(F.col("output"), F.array("gold"), F.col("lang")), 9).alias("f1"))


@query(_MANY + "SELECT doc_id, CASE WHEN len(b) > 0 THEN round(k::DOUBLE / len(b), 9) END AS recall FROM c")
def gold_recall_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall = sc.gold_recall(sc.tokenize(F.col("output"), F.col("lang")), sc.tokenize(F.col("gold"), F.col("lang")))
    return _wide(spark, sf_dir).select("doc_id", F.round(recall, 9).alias("recall"))


@query(f"SELECT doc_id, c.output, c.gold, ok AS em, ok AS lenient FROM documents, (VALUES {_CASE_ROWS}) c(output, gold, ok)")
def unicode_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that are a gold in another Unicode form, behind an earlier marked region with the text of every document.

    The text is no prose before the first marker: its own words would count there.
    """
    cases = F.explode(F.array(*(F.struct(F.lit(o).alias("output"), F.lit(g).alias("gold")) for o, g, _ in _CASES)))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", cases.alias("c")).select("doc_id", "text", "c.*")
    before = F.concat(F.lit("What was found follows. \n#### "), F.coalesce("text", F.lit("")), F.lit("\n"))
    args = F.concat(before, F.col("output")), F.array("gold"), F.lit("fr")
    return rows.select("doc_id", "output", "gold", sc.span_scores(*args)["em"].alias("em"), sc.containment_lenient(*args).alias("lenient"))


_SCRIPTS = {c: rf"\p{{{c}}}" for c in pf.CLASSES if c not in ("Han", "Other")} | {"Han": r"[\p{Han}\p{Hiragana}\p{Katakana}]"}
# words that are added to texts, so that every class occurs
_WORDS_OF = ("", "Привет мир", "สวัสดี", "নমস্কার ১২", "నమస్తే", "안녕", "مرحبا", "नमस्ते", "Καλημέρα", "漢字 ひらがな カタカナ", "Ա ա ა")
_WRITTEN = "SELECT doc_id, regexp_replace(text || CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_WORDS_OF)) + r" END, '[^\p{L}]+', '', 'g') AS t FROM documents"
_OF_SCRIPT = ", ".join(f"len(regexp_extract_all(t, '{p}'))::BIGINT AS \"{n}\"" for n, p in _SCRIPTS.items())


@query(f"""SELECT *, letters - {' - '.join(f'"{n}"' for n in _SCRIPTS)} AS "Other" FROM (SELECT doc_id, {_OF_SCRIPT}, length(t)::BIGINT AS letters FROM ({_WRITTEN}))""")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of every script, in texts to which words of all scripts are added."""
    word = F.element_at(F.array(*map(F.lit, _WORDS_OF)), (F.pmod("doc_id", F.lit(len(_WORDS_OF))) + 1).cast("int"))
    counts = table(spark, sf_dir, "documents").select("doc_id", pf.letters(F.concat("text", word)).alias("n"))
    return counts.select("doc_id", *(F.col(f"n.{c}") for c in (*pf.CLASSES, "letters")))


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\\[a-zA-Z]+|[\\${}^_*#`|~=+\-×÷/<>()\[\]]|\p{Nd}', ' ', 'g'), '\s+', ' ', 'g'))) AS clean_md5 FROM documents"""
)
def lid_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(pf.lid_text(F.col("text"))).alias("clean_md5"))


_EXPECT = "CASE doc_id % 3 WHEN 0 THEN 'vi' WHEN 1 THEN 'el' ELSE lang END"
_MARKS = f"len(regexp_extract_all(text, '[{pf.VIETNAMESE}]'))"


@query(
    rf"""WITH t AS (SELECT doc_id, {_EXPECT} AS code, len(regexp_extract_all(text, '\p{{L}}')) AS n, len(regexp_extract_all(text, '\p{{Latin}}')) AS latin,
len(regexp_extract_all(text, '\p{{Greek}}')) AS greek, {_MARKS} AS marks FROM documents)
SELECT doc_id, code, round(CASE WHEN n = 0 THEN NULL WHEN code = 'el' THEN 1.0 - greek::DOUBLE / n WHEN code = 'vi' THEN
CASE WHEN marks::DOUBLE / greatest(latin, 1) < 0.02 THEN 1.0 ELSE (n - latin)::DOUBLE / n END END::DOUBLE, 9) AS drift FROM t"""
)
def drift_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift by scripts where a third of the texts is taken for Vietnamese and a third for Greek."""
    kind = F.pmod("doc_id", F.lit(3))
    code = F.when(kind == 0, "vi").when(kind == 1, "el").otherwise(F.col("lang"))
    script = F.when(F.col("code") == "el", "Greek").otherwise(F.lit("Latin"))
    rows = table(spark, sf_dir, "documents").withColumn("code", code).withColumn("n", pf.canonical_letters("text"))
    return rows.select("doc_id", "code", F.round(pf.drift_by_script(F.col("n"), F.col("code"), script), 9).alias("drift"))


@query()
def drift_lid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift by a language model of every line with 30 letters or more, weighted by letters; null without such a line.

    The model is counted from all documents by their declared language.
    """
    labels = spark.createDataFrame([(c, label) for c, _, _, label in pf.LANGUAGES], "lang string, label string")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(labels), "lang", "left")  # null for languages that are not on the list
    judge = langmodel.judge_of(langmodel.train(docs.select("label", "text")))
    return langmodel.drift(docs, "doc_id", "text", "label", judge).select("doc_id", F.round("drift", 9).alias("drift"))


_FERT = r"""SELECT lang, sum(len(regexp_extract_all(text, '\S+'))) AS tokens, sum(octet_length(encode(text))) AS bytes, sum(length(text)) AS chars, count(*) AS n FROM documents GROUP BY lang"""


def _fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.regexp_count("text", F.lit(r"\S+"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.sum(tokens).alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")
    )


@query(
    f"""SELECT lang, n, tokens::BIGINT AS tokens, round(tokens::DOUBLE / bytes, 9) AS tokens_per_byte, round(tokens::DOUBLE / chars, 9) AS tokens_per_char,
round(bytes::DOUBLE / tokens, 9) AS bytes_per_token FROM ({_FERT})"""
)
def fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 9).alias(f"{a}_per_{b.rstrip('s')}")
    return _fertility(spark, sf_dir).select("lang", "n", "tokens", ratio("tokens", "bytes"), ratio("tokens", "chars"), ratio("bytes", "tokens"))


@query(f"WITH f AS ({_FERT}) SELECT f.lang, round((f.tokens::DOUBLE / f.n) / (e.tokens::DOUBLE / e.n), 9) AS relative FROM f JOIN f e ON e.lang = 'en'")
def fertility_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.col("tokens") / F.col("n")
    rows = _fertility(spark, sf_dir).select("lang", mean.alias("m"))
    anchor = F.max(F.when(F.col("lang") == "en", F.col("m"))).over(W.Window.partitionBy(F.lit(1)))  # a row for each language
    return rows.select("lang", F.round(F.col("m") / anchor, 9).alias("relative"))


# word ends are those of all letters, as RE2 knows only the ASCII ones
_OUT = r"[^\p{L}\p{N}_]"
_ENDS = [(label, re.sub(r"\\b(?=[a-z(])", rf"(?:^|{_OUT})".replace("\\", r"\\"), p)) for label, p in pf.LINT]
_FOUND = [f"regexp_matches(sentence, '(?i){p}')" for p in (p.replace(r"\b", rf"(?:$|{_OUT})").replace("'", "''") for _, p in _ENDS)]
_LINT_SUMS = ", ".join(f"count(*) FILTER ({f}) AS n{i}, coalesce(sum(line) FILTER ({f}), 0)::BIGINT AS s{i}" for i, f in enumerate(_FOUND))
_LINT = " UNION ALL ".join(f"SELECT '{label}' AS label, n{i} AS n, s{i} AS lines, a AS n_sentences FROM k" for i, (label, _) in enumerate(_ENDS))


@query(
    rf"""WITH l AS (SELECT list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '(^|[^\\])%.*$', '\1'), '\s+', ' ', 'g'))) AS l FROM documents),
p AS (SELECT unnest(string_split_regex(array_to_string(list_transform(l, lambda x, i: CASE WHEN x = '' THEN '' ELSE chr(1) || i || chr(2) || x END), chr(10)), '\n\n+')) AS p FROM l),
t AS (SELECT regexp_extract(p, '\x01([0-9]+)\x02', 1)::BIGINT AS line, trim(replace(regexp_replace(p, '\x01[0-9]+\x02', '', 'g'), chr(10), ' ')) AS t FROM p WHERE contains(p, chr(2))),
s AS (SELECT line, trim(unnest(string_split(regexp_replace(t, '([.!?]) ([A-Z(\\])', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS sentence FROM t),
k AS (SELECT count(*) AS a, {_LINT_SUMS} FROM s WHERE sentence <> '') {_LINT}"""
)
def claim_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents that each rule finds, and the sum of their lines; the rules are seven and fixed."""
    rows = table(spark, sf_dir, "documents").select(F.inline(pf.sentences(F.col("text"))))
    found = [F.regexp_like("sentence", F.lit(f"(?i){p}")) for _, p in pf.LINT]
    sums = rows.agg(F.count("*").alias("all"), *(x for i, f in enumerate(found) for x in (F.count_if(f).alias(f"n{i}"), F.sum(F.when(f, F.col("line"))).alias(f"s{i}"))))
    each = [F.struct(F.lit(label).alias("label"), F.col(f"n{i}").alias("n"), F.coalesce(f"s{i}", F.lit(0)).alias("lines"), F.col("all").alias("n_sentences")) for i, (label, _) in enumerate(pf.LINT)]
    return sums.select(F.inline(F.array(*each)))


_GRAMS = "SELECT conv_id, turn, n, substr(t, i, n) AS g, count(*) AS k FROM (SELECT conv_id, turn, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM {0}, range(1, 7) r(n) WHERE length(t) >= n) GROUP BY ALL"


@query(
    rf"""WITH pr AS (SELECT conv_id, turn, regexp_replace(text, '\s+', '', 'g') AS h, regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '\s+', '', 'g') AS r FROM conversations),
p AS (SELECT * FROM pr WHERE r IS NOT NULL), gh AS ({_GRAMS.format("(SELECT conv_id, turn, h AS t FROM p)")}), gr AS ({_GRAMS.format("(SELECT conv_id, turn, r AS t FROM p)")}),
th AS (SELECT conv_id, turn, n, sum(k) AS s FROM gh GROUP BY ALL), tr AS (SELECT conv_id, turn, n, sum(k) AS s FROM gr GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(least(gh.k, gr.k)) AS c FROM gh JOIN gr USING (conv_id, turn, n, g) GROUP BY ALL),
a AS (SELECT conv_id, turn, avg(coalesce(c, 0) / th.s) AS ap, avg(coalesce(c, 0) / tr.s) AS ar FROM th JOIN tr USING (conv_id, turn, n) LEFT JOIN m USING (conv_id, turn, n) GROUP BY ALL)
SELECT p.conv_id, p.turn, round(CASE WHEN ap IS NULL OR ap + ar = 0 THEN 0.0 ELSE 500 * ap * ar / (4 * ap + ar) END, 6) AS chrf FROM p LEFT JOIN a USING (conv_id, turn)"""
)
def chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrF of every turn against the one before it."""
    line = W.Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("ref", F.lag("text").over(line)).where("ref is not null")
    return rows.select("conv_id", "turn", F.round(pf.chrf(F.col("text"), F.col("ref")), 6).alias("chrf"))


@query(
    """SELECT doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS "rank",
row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) <= 10 AS flagged FROM documents"""
)
def rank_and_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by a score, and the lowest ten of each language flagged."""
    ranked = ranks.placed(table(spark, sf_dir, "documents").select("lang", "n_chars", "doc_id"), ["lang"], "n_chars", "doc_id", "rank")
    return ranked.select("doc_id", "n_chars", "rank", (F.col("rank") <= 10).alias("flagged"))


@query(
    """SELECT lang, min(n_chars) AS lo, list_sort(list(n_chars))[(count(*) // 4 + 1)::BIGINT] AS p25, list_sort(list(n_chars))[(count(*) // 2 + 1)::BIGINT] AS median,
max(n_chars) AS hi FROM documents GROUP BY lang"""
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, lower quartile, median and largest by place in the order; ranks instead of gathered lists."""
    rows = table(spark, sf_dir, "documents").select("lang", "n_chars")
    ends = rows.groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return ranks.at_share(rows, "lang", "n_chars", {"p25": 0.25, "median": 0.5}).drop("n").join(ends, "lang")


@query(
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k, lang, doc_id IN (SELECT doc_id FROM labels) AS a FROM documents)
SELECT lang, k, printf('## F%d. doc-%s-%d  (score %.1f)%s', k, lang, doc_id, n_chars::DOUBLE, CASE WHEN a THEN ' *(already in the audit)*' ELSE '' END) AS line FROM r WHERE k <= 10"""
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a review report: the ten lowest of each language, with a mark for those already audited."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("a", F.lit(True))
    k = F.row_number().over(W.Window.partitionBy("lang").orderBy("n_chars", "doc_id")).cast("long")
    top = table(spark, sf_dir, "documents").withColumn("k", k).where("k <= 10").join(labels, "doc_id", "left")
    note = F.when(F.col("a"), " *(already in the audit)*").otherwise(F.lit(""))
    line = F.format_string("## F%d. doc-%s-%d  (score %.1f)%s", "k", "lang", "doc_id", F.col("n_chars").cast("double"), note)
    return top.select("lang", "k", line.alias("line"))


@query("SELECT doc_id FROM documents")
def report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids read back from the headings of a report that was written as text."""
    folder = shared_folder(spark, "report")
    head = F.format_string("## F%d. doc-%s-%d  (x)", F.col("doc_id") + 1, "lang", "doc_id")
    body = F.concat(head, F.lit("\n\n"), F.regexp_replace("text", "(?m)^## ", ""))
    write_lines(table(spark, sf_dir, "documents").select("doc_id", body.alias("line")), folder, "doc_id")
    lines = spark.read.text(folder).where(F.col("value").startswith("## F"))
    return lines.select(F.regexp_extract("value", r"^## F[0-9]+\. doc-[a-z]+-([0-9]+)", 1).cast("long").alias("doc_id"))


@query("SELECT source, count(*) AS n_lines, bool_or(contains(l, 'token')) AS seen FROM (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY source")
def marker_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Has any line of a source's log the marker?  Logs are text files, one folder a source."""
    folder = shared_folder(spark, "logs")
    table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(folder)
    lines = spark.read.option("lineSep", "\n").text(folder)
    return lines.groupBy("source").agg(F.count("*").alias("n_lines"), F.bool_or(F.contains("value", F.lit("token"))).alias("seen"))


_OFFSET = "to_minutes((CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 13 * 60 + event_id % 4 * 15))::INT)"
_MARK = "chr(39)"


@query(f"SELECT event_id, 'at ' || strftime(date_trunc('second', ts) - {_OFFSET}, 'D:%Y%m%d%H%M%S') || '+00' || {_MARK} || '00' || {_MARK} || ' ok' AS utc FROM events")
def utc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events with offsets of all kinds, as UTC."""
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    sign = F.when(F.pmod("event_id", F.lit(2)) == 0, "+").otherwise("-")
    local = F.concat(F.lit("at D:"), F.date_format("ts", "yyyyMMddHHmmss"), sign, two(F.pmod("event_id", F.lit(13))), F.lit("'"), two(F.pmod("event_id", F.lit(4)) * 15), F.lit("' ok"))
    return table(spark, sf_dir, "events").select("event_id", pf.utc_stamps(local).alias("utc"))


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*[0-9]+\s*', '')) <> '')) END::INT AS n FROM documents"""
)
def page_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text that stand before a heading on the second page; a fifth of the texts has no such heading."""
    heading = F.when(F.pmod("doc_id", F.lit(5)) != 0, F.lit("\n E THICS  STATEMENT\nrest")).otherwise("\nrest")
    pages = F.concat(F.lit("1 first\nbody\f2 head\n"), "text", heading)
    return table(spark, sf_dir, "documents").select("doc_id", pf.spill_lines(pages, r"E\s*THICS\s+STATEMENT").alias("n"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'SUSPECT' WHEN 2 THEN 'SUSPECT' ELSE 'ERROR' END AS verdict,
CASE WHEN doc_id % 5 IN (1, 2, 3) THEN doc_id % 5 ELSE 0 END::INT AS n_issues, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN text END AS quoted FROM documents"""
)
def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of replies in JSON that quote whole texts; what cannot be read, or names no verdict, is an error."""
    kind = F.pmod("doc_id", F.lit(5)).cast("int")
    issue = F.struct(F.lit("number").alias("type"), F.col("text").alias("en_quote"), F.lit('"x"').alias("vi_quote"), F.lit("\\").alias("detail"))
    verdict = F.when(kind == 0, "OK").when(kind <= 2, "SUSPECT")
    made = F.to_json(F.struct(verdict.alias("verdict"), F.array_repeat(issue, F.when(kind <= 3, kind).otherwise(0)).alias("issues")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(kind == 4, F.concat(F.lit("Sure! "), made)).otherwise(made).alias("reply"))
    rows = rows.withColumn("r", pf.verdict_of(F.col("reply")))
    return rows.select("doc_id", "r.verdict", F.size("r.issues").alias("n_issues"), F.get("r.issues", F.lit(0))["en_quote"].alias("quoted"))


_ASK = "Compare. Reply in JSON.\n\nA: {en}\n\nB: {vi}"


@query("SELECT a.doc_id, md5('Compare. Reply in JSON.' || chr(10) || chr(10) || 'A: ' || a.text || chr(10) || chr(10) || 'B: ' || b.text) AS prompt_md5 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def audit_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that ask for a comparison of each document with the next one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return pairs.select("doc_id", F.md5(pf.audit_prompt(_ASK, F.col("text"), F.col("other"))).alias("prompt_md5"))


@query(
    rf"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(t) ELSE nullif(trim(regexp_extract(before, '(?s)^(.*[.!?。！？।])', 1)), '') END AS rest FROM (SELECT doc_id, text AS t,
CASE doc_id % 3 WHEN 1 THEN text || ' End with ' || {_MARK} ELSE replace(replace(replace(text, '.', ','), '!', ','), '?', ',') END AS before FROM documents)"""
)
def strip_marker_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the sentence that asks for a marker: without any, with one at the end, and with no sentence before it."""
    kind = F.pmod("doc_id", F.lit(3))
    asked = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat("text", F.lit(" End with '#### <x>'."))).otherwise(F.concat(F.translate("text", ".!?", ",,,"), F.lit("#### x")))
    return table(spark, sf_dir, "documents").select("doc_id", pf.strip_marker_sentence(asked).alias("rest"))


@query(r"SELECT page_id, len(regexp_extract_all(regexp_replace(url, '[0-9]+|[?#].*', '', 'g'), '[A-Za-z]+'))::BIGINT AS n FROM pages")
def template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a template without its placeholders; here URLs without numbers and queries."""
    bare = F.regexp_replace("url", r"[0-9]+|[?#].*", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(bare, F.lit("[A-Za-z]+")).cast("long").alias("n"))


@query()
def nfd_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much longer texts are with their accents as characters of their own."""
    docs = table(spark, sf_dir, "documents").withColumn("apart", unicode.nfd(F.col("text")))
    grown = F.sum(F.length("apart")) / F.sum(F.length("text"))
    return docs.groupBy("lang").agg(F.round(grown, 9).alias("chars"), F.round(F.sum(F.octet_length("apart")) / F.sum(F.octet_length("text")), 9).alias("bytes"))
