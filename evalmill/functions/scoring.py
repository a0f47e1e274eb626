"""Answers in generated text: numbers, spans, normal forms and matches, as column expressions.

Digits are Unicode decimal digits, white space is Unicode white space, and letters and digits at a boundary are the
general categories L and N.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import ascii_digits, bound, nfkc

MARKER = "####"
TOLERANCE = 1e-6
# Languages written without spaces, and articles of those that have them.
CHAR_LANGS = ("zh", "ja", "th")
ARTICLES = {
    "en": ["a", "an", "the"],
    "es": ["el", "la", "los", "las", "un", "una", "unos", "unas"],
    "de": ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines"],
}
# Placeholders of instructions that are repeated instead of an answer; longer ones before their beginnings.
PLACEHOLDERS = [
    "exact answer span",
    "fragmento exacto de la respuesta",
    "extrait exact de la réponse",
    "exakte Antwortpassage",
    "точный фрагмент ответа",
    "原文中的答案片段",
    "本文中の正確な答え",
    "ข้อความคำตอบตรงตามต้นฉบับ",
    "kifungu halisi cha jibu",
    "সঠিক উত্তরাংশ",
    "সঠিক সংশ্লিষ্ট উত্তর",
    "সঠিক উত্তর",
    "সঠিক উপাংশ",
    "ఖచ్చితమైన సమాధాన భాగం",
    "cụm từ trả lời chính xác",
]
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BREAK = r"(?:\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}])"


#: The characters of SPACE, for functions that look at the ends of a text only.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


# ---------------------------------------------------------------- numbers


def number_interpretations(token: Column) -> Column:
    """All readings of a number: with both separators the right one is decimal; a single kind may group, or divide."""
    t = F.regexp_replace(strip(ascii_digits(token)), "[.,]+$", "")
    dot, comma = F.instr(t, "."), F.instr(t, ",")
    last = lambda c: F.length(t) - F.instr(F.reverse(t), c)
    number = lambda c: c.try_cast("double")
    both = F.when(last(".") > last(","), F.replace(t, F.lit(","), F.lit(""))).otherwise(
        F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    )
    bare = F.regexp_replace(t, "^-+", "")
    grouped = bare.rlike(r"^[^.,]{1,3}(?:\.[^.,]{3})+$") | bare.rlike("^[^.,]{1,3}(?:,[^.,]{3})+$")
    single = bare.rlike("^[^.,]*[.,][^.,]*$")
    one = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(grouped, number(F.regexp_replace(t, "[.,]", ""))),
                F.when(single, number(F.replace(t, F.lit(","), F.lit(".")))),
            )
        )
    )
    none = F.array().cast("array<double>")
    return (
        F.when(~t.rlike("[0-9]"), none)
        .when((dot > 0) & (comma > 0), F.array_compact(F.array(number(both))))
        .when((dot > 0) | (comma > 0), one)
        .otherwise(F.array_compact(F.array(number(t))))
    )


def last_number(text: Column) -> Column:
    """The last number behind the last marker, or else of the whole text; null without one."""
    t = ascii_digits(text)
    last = lambda zone: F.try_element_at(F.regexp_extract_all(zone, F.lit(r"(-?[0-9][0-9.,]*)"), 1), F.lit(-1))
    after = F.when(F.instr(t, MARKER) > 0, last(F.substring_index(t, MARKER, -1)))
    return F.coalesce(after, last(t))


def extract_candidates(text: Column) -> Column:
    return F.coalesce(number_interpretations(last_number(text)), F.array().cast("array<double>"))


def parse_gold(gold: Column) -> Column:
    return F.replace(strip(gold), F.lit(","), F.lit("")).cast("double")


def numeric_match(text: Column, gold: Column) -> Column:
    return F.exists(extract_candidates(text), lambda c: F.abs(c - gold) <= TOLERANCE)


# ---------------------------------------------------------------- spans


def _clean(region: Column) -> Column:
    # a fixed pattern: a placeholder in angle brackets, with blanks and a slash at most beside it
    quoted = "|".join(PLACEHOLDERS)

    def unbracketed(x: Column) -> Column:
        bare = F.translate(F.regexp_replace(x["t"], rf"<{SPACE}*/?{SPACE}*(?:{quoted}){SPACE}*>", " "), "<>", "  ")
        return F.when(x["t"].rlike("[<>]"), bare).otherwise(x["t"])

    return strip(F.rtrim(bound(unbracketed, t=region), F.lit("#" + SPACES)))


_FULL = r"[\p{L}\p{N}_]"


def _marked(text: Column) -> Column:
    """What follows the last marker that has content behind it, up to the end of the text, cleaned; null without one.

    Content is looked for between markers, so a text of many markers is read once.
    """

    def of(x: Column) -> Column:
        n = F.size(x["parts"])
        full = F.transform(x["parts"], lambda p, i: (i > 0) & _clean(p).rlike(_FULL))
        back = F.array_position(F.reverse(full), True).cast("int")  # from the end
        return F.when(back > 0, _clean(F.array_join(F.slice(x["parts"], n - back + 1, back), MARKER)))

    return bound(of, parts=F.split(text, MARKER))


def extract_span(text: Column) -> Column:
    """The last marked region with content; without one the whole text; empty when that has no content either."""
    whole = bound(lambda x: F.when(x["whole"].rlike(_FULL), x["whole"]), whole=_clean(text))
    return F.coalesce(_marked(text), whole, F.lit(""))


def marked_span(text: Column) -> Column:
    """The same without falling back to the whole text; null without a marked region."""
    return _marked(text)


def first_sentence(text: Column) -> Column:
    """The first sentence before the first marker, or else the first line's first 160 characters."""
    # white space around the prose does not count: neither what stands before it, nor as what ends its last sentence
    blank = SPACE[1:-1]
    sentence = rf"(?s)^{SPACE}*(.*?[.!?。！？؟।॥])(?:\x{{200B}}|{SPACE}(?={SPACE}*[^{blank}]))"
    first_line = rf"(?s)^{SPACE}*(.*?)(?:{SPACE}*\z|{_BREAK})"

    def of(x: Column) -> Column:
        line = F.substring(F.regexp_extract(x["prose"], first_line, 1), 1, 160)
        return bound(lambda y: F.when(y["sentence"] != "", y["sentence"]).otherwise(line), sentence=F.regexp_extract(x["prose"], sentence, 1))

    return bound(of, prose=F.substring_index(text, MARKER, 1))


# ---------------------------------------------------------------- normal forms and matches


def normalize(text: Column, lang: Column) -> Column:
    """NFKC, small letters, punctuation and symbols as spaces, no articles, single spaces."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(nfkc(text)), rf"[\p{{P}}\p{{S}}{SPACE[1:-1]}]+", " "), F.lit(" "))

    def bare(x: Column) -> Column:
        out = x["t"]
        for code, articles in ARTICLES.items():
            out = F.when(lang == code, F.regexp_replace(x["t"], f"(?<= )(?:{'|'.join(articles)}) ", "")).otherwise(out)
        return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))

    return bound(bare, t=spaced)


def tokens_of(normal: Column, lang: Column) -> Column:
    """Tokens of a normal form: characters for languages without spaces, else words."""
    chars = F.filter(F.split(F.replace(normal, F.lit(" "), F.lit("")), ""), lambda c: c != "")
    return F.when(lang.isin(*CHAR_LANGS), chars).otherwise(F.filter(F.split(normal, " "), lambda w: w != ""))


def tokenize(text: Column, lang: Column) -> Column:
    return bound(lambda x: tokens_of(x["normal"], lang), normal=normalize(text, lang))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: both are sorted together, and runs of one token are counted."""
    tagged = lambda arr, side: F.transform(arr, lambda x: F.struct(x.alias("t"), F.lit(side).alias("s")))
    b = F.when(F.size(a) <= 8, F.filter(b, lambda x: F.array_contains(a, x))).otherwise(b)  # few tokens are looked for one by one

    def runs(x: Column) -> Column:
        line = x["line"]
        begins = F.transform(line, lambda e, i: F.when((i == 0) | (F.get(line, i - 1) != e), i))

        def common(y: Column) -> Column:
            starts, n = y["starts"], F.size(line)

            def least(start: Column, j: Column) -> Column:
                """Of a run of the first array and the run behind it, if that is of the same token in the second one."""
                following, end = F.get(starts, j + 1), F.coalesce(F.get(starts, j + 2), n)
                both = (F.get(line, start)["s"] == 0) & (F.get(line, following)["t"] == F.get(line, start)["t"])
                return F.when(both, F.least(following - start, end - following)).otherwise(0)

            return F.aggregate(F.transform(starts, least), F.lit(0), lambda s, k: s + k)

        return bound(common, starts=F.filter(begins, lambda i: i.isNotNull()))

    return bound(runs, line=F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two token arrays; both empty is 1, one empty is 0."""
    common = overlap(gold, pred)
    return (
        F.when((F.size(pred) == 0) & (F.size(gold) == 0), 1.0)
        .when((F.size(pred) == 0) | (F.size(gold) == 0) | (common == 0), 0.0)
        .otherwise(2.0 * common / (F.size(pred) + F.size(gold)))
    )


def _best_f1(normal: Column, golds: Column, lang: Column) -> Column:
    """Of normal forms."""
    tokens = F.transform(golds, lambda g: tokens_of(g, lang))
    return bound(lambda x: F.array_max(F.transform(x["golds"], lambda g: token_f1(x["pred"], g))), pred=tokens_of(normal, lang), golds=tokens)


def _contains(normal: Column, golds: Column, lang: Column) -> Column:
    """Of normal forms."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))

    def inside(g: Column) -> Column:
        whole = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), g, F.lit(r"\E(?![\p{L}\p{N}])"))
        found = F.when(lang.isin(*CHAR_LANGS), F.instr(bare(normal), bare(g)) > 0).otherwise(F.regexp_like(normal, whole))
        return (g != "") & found

    return (normal != "") & F.exists(golds, inside)


def _normals(golds: Column, lang: Column) -> Column:
    return F.transform(golds, lambda g: normalize(g, lang))


def f1(pred: Column, golds: Column, lang: Column) -> Column:
    """The best F1 over the golds; null without any."""
    return bound(lambda x: _best_f1(x["normal"], x["golds"], lang), normal=normalize(pred, lang), golds=_normals(golds, lang))


def exact_match(pred: Column, golds: Column, lang: Column) -> Column:
    return bound(lambda x: F.array_contains(x["golds"], x["normal"]), normal=normalize(pred, lang), golds=_normals(golds, lang))


def containment(pred: Column, golds: Column, lang: Column) -> Column:
    """Is a gold inside the prediction, not cut out of a longer word or number?"""
    return bound(lambda x: _contains(x["normal"], x["golds"], lang), normal=normalize(pred, lang), golds=_normals(golds, lang))


def containment_lenient(output: Column, golds: Column, lang: Column) -> Column:
    """Is a gold inside the span, or inside the first sentence?  Normal forms of the golds are made once."""

    def of(x: Column) -> Column:
        inside = lambda text: bound(lambda y: _contains(y["normal"], x["golds"], lang), normal=normalize(text, lang))
        return inside(extract_span(output)) | inside(first_sentence(output))

    return bound(of, golds=_normals(golds, lang))


def containment_marker_only(output: Column, golds: Column, lang: Column) -> Column:
    return F.coalesce(containment(marked_span(output), golds, lang), F.lit(False))


def span_scores(output: Column, golds: Column, lang: Column) -> Column:
    """em, em_strict and f1 of the span, which is found and brought to its normal form once."""

    def of(x: Column) -> Column:
        normal, own = x["normal"], x["golds"]
        return F.struct(_contains(normal, own, lang).alias("em"), F.array_contains(own, normal).alias("em_strict"), _best_f1(normal, own, lang).alias("f1"))

    return bound(of, normal=normalize(extract_span(output), lang), golds=_normals(golds, lang))


def gold_recall(pred: Column, gold: Column) -> Column:
    """Share of the gold's tokens that the prediction has, as multisets; null for an empty gold."""
    return bound(lambda x: F.when(F.size(x["gold"]) > 0, overlap(x["gold"], x["pred"]) / F.size(x["gold"])), pred=pred, gold=gold)


# Spellings that count as one.
SPELLINGS = {"ী": "ি", "ষ্": "স্"}


def fold_spelling(text: Column) -> Column:
    for a, b in SPELLINGS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def output_stats(text: Column) -> Column:
    return F.struct(
        F.size(words(text)).alias("n_output_tokens"), F.octet_length(text).alias("output_bytes"), F.length(text).alias("output_chars")
    )
