"""Unicode normal forms and decimal digits, inside the JVM.

Spark's own collations rest on the ICU library, so its classes are there on every driver and worker.  Its normaliser is
called by reflection, and only for texts with characters beyond ASCII.  Spark takes such calls for non-deterministic: they
may not stand inside an aggregate function, but in a column that is aggregated.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(make: Callable[[Column], Column], **columns: Column) -> Column:
    """``make`` of a struct of the columns: each is computed once, however often the result names it."""
    one = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return F.element_at(F.transform(one, make), 1)


def _normal(text: Column, method: str, compatible: bool) -> Column:
    def of(x: Column) -> Column:
        called = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), x["t"], F.lit(compatible))
        return F.when(x["t"].rlike(r"[^\x00-\x7F]"), called).otherwise(x["t"])

    return bound(of, t=text)


def nfkc(text: Column) -> Column:
    return _normal(text, "compose", True)


def nfc(text: Column) -> Column:
    return _normal(text, "compose", False)


def nfd(text: Column) -> Column:
    return _normal(text, "decompose", False)


# every script has its ten decimal digits in a row
_ZEROS = [chr(c) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) == 0]


def ascii_digits(text: Column) -> Column:
    """Decimal digits of all scripts as 0-9."""
    every = "".join(chr(ord(z) + d) for z in _ZEROS for d in range(10))

    def of(x: Column) -> Column:
        return F.when(x["t"].rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(x["t"], every, "0123456789" * len(_ZEROS))).otherwise(x["t"])

    return bound(of, t=text)
