"""Golds as they are stored: a JSON array, a list as Python writes it, a scalar, or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import bound

_QUOTED = r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*\""""
_ELEMENT = rf"""(?:{_QUOTED}|[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?|True|False|None)"""
_LIST = rf"(?s)^\[\s*(?:{_ELEMENT}\s*(?:,\s*{_ELEMENT}\s*)*,?\s*)?\]$"
_PIECE = r"(?s)(\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|[^\\]+)"
_ESCAPED = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\'": "'", '\\"': '"', "\\\\": "\\", "\\/": "\\/", "\\b": "\b", "\\f": "\f", "\\a": "\a", "\\v": "\v", "\\0": "\0", "\\\n": ""}


def _unescaped(text: Column) -> Column:
    def piece(p: Column) -> Column:
        coded = F.regexp_extract(p, r"^\\[ux]([0-9a-fA-F]+)$", 1)
        out = F.when(coded != "", F.decode(F.unhex(F.lpad(coded, 4, "0")), "UTF-16BE"))
        for written, meant in _ESCAPED.items():
            out = out.when(p == written, meant)
        return out.otherwise(p)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), 1), piece), "")).otherwise(text)


def _value(element: Column) -> Column:
    """An element as the text that Python prints for it."""
    inner = F.substring(element, F.lit(2), F.length(element) - 2)
    number = F.when(element.rlike("[.eE]"), element.try_cast("double").cast("string")).otherwise(F.regexp_replace(element, r"^\+|^(-?)0+(?=[0-9])", "$1"))
    return F.when(element.rlike("^['\"]"), _unescaped(inner)).when(element.rlike("^[-+0-9]"), number).otherwise(element)


def decode_golds(stored: Column) -> Column:
    """An array of strings.  White space around does not count; what begins like a list but is none is a scalar, and an empty
    text or null gives no gold.  Strings may stand in either kind of quotes, with escapes; numbers and names come as Python
    prints them.  Lists in lists are scalars."""

    def of(x: Column) -> Column:
        s = x["s"]
        elements = F.transform(F.regexp_extract_all(s, F.lit(f"({_ELEMENT})"), 1), _value)
        none = F.array().cast("array<string>")
        return F.when(s.isNull() | (s == ""), none).when(s.rlike(_LIST), elements).otherwise(F.array(s))

    return bound(of, s=F.regexp_replace(stored, r"^\s+|\s+$", ""))
