"""Secret scans: fixed patterns, and Shannon entropy in a window that slides over candidate strings.

A candidate is a longest run of one character class.  The window keeps the count of every character and the sum of
count * log2(count); a step changes two counts, so a run costs time in proportion to its length.  Where a window's
entropy reaches the bits of its class, it is suspicious; neighbouring suspicious windows join into one span.  Runs on
the allow-list (words, numbers, UUIDs, digests that are named as such) give none, and windows that hold a placeholder, or
a whole word between hyphens, slashes or underscores as addresses and paths have them, are passed over; the rest of their
run is still judged.

Null texts count as empty and have no spans.  Offsets are code points, ends exclusive.  Whole texts are scanned, in time
in proportion to their length.  Each row is judged alone, so rows that repeat give the same; columns with the names of
new ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import annotate

# The base patterns, with the least length of what counts (a group's or the match's).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "entropy")  # in the order in which spans with the same start stand


@dataclass(frozen=True)
class CharClass:
    name: str
    run: str  # pattern of a candidate
    window: int
    bits: float


# Entropy is at most log2(window); random hex of 24 has about 3.5 bits, random base64 of 24 about 4.3.
CLASSES = (
    CharClass("hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}", 24, 3.0),
    CharClass("base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)
# Candidates that are no secret though they look random, and words that make what lies around them harmless.
ALLOW = (
    r"[0-9]+",
    r"[A-Za-z_+/=-]+",
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?i:md5|sha1|sha256|sha384|sha512|commit|checksum|digest|integrity)[-=]+[A-Za-z0-9+/]+=*",
)
ALLOW_INSIDE = r"EXAMPLE|example|placeholder|xxxxxx|XXXXXX|(?:^|(?<=[-/_]))(?:[a-z]{2,}|[A-Z][a-z]+)(?=[-/_])"
# Names after which a digest stands openly.
ALLOW_BEFORE = r"(?:md5|sha1|sha256|sha512|commit|checksum|digest|integrity)[-:= ]{1,3}"

SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("spans", T.ArrayType(SPAN))]
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def suspicious(text: str, window: int, bits: float, harmless: list[tuple[int, int]] = []) -> list[tuple[int, int]]:  # noqa: B006
    """Joined windows of ``text`` whose entropy is at least ``bits``, but for those that hold one of the harmless spans."""
    if len(text) < window:
        return []
    passed = bytearray(len(text))
    for a, b in harmless:
        low = max(0, b - window)
        passed[low : a + 1] = b"\1" * max(0, a + 1 - low)
    log = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    most = window * (math.log2(window) - bits) + 1e-9  # entropy = log2(window) - total / window
    out: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += log[n - 1] - log[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        start = i - window + 1
        if start >= 0 and total <= most and not passed[start]:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


class Scanner:
    def __init__(
        self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, allow_before: str = ALLOW_BEFORE, allow_inside: str = ALLOW_INSIDE
    ):
        self.classes = [(re.compile(c.run), c) for c in classes]
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else None
        self.inside = re.compile(allow_inside) if allow_inside else None
        self.before = re.compile(f"(?:{allow_before})$", re.I | re.A) if allow_before else None

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """start, kind, end of what the fixed patterns find, leftmost and without overlap in each kind."""
        found = []
        if ":" in text or "=" in text:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def entropy(self, text: str) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for pattern, c in self.classes:
            for m in pattern.finditer(text):
                if self.allow and self.allow.fullmatch(m[0]):
                    continue
                if self.before and self.before.search(text, max(0, m.start() - 16), m.start()):
                    continue
                harmless = [x.span() for x in self.inside.finditer(m[0])] if self.inside else []
                found += [(m.start() + a, m.start() + b) for a, b in suspicious(m[0], c.window, c.bits, harmless)]
        joined: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        return joined

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """start, kind, end of all spans in order; entropy spans that lie in a base span add nothing."""
        found = self.base(text)
        more, at, reach = [], 0, 0
        for a, b in self.entropy(text):  # in order, as the others are: reach is the furthest end of those that begin by then
            while at < len(found) and found[at][0] <= a:
                reach = max(reach, found[at][2])
                at += 1
            if b > reach:
                more.append((a, 3, b))
        return sorted(found + more) if more else found


def scan_secrets(
    docs: DataFrame,
    text_col: str = "text",
    classes: tuple[CharClass, ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
    allow_before: str = ALLOW_BEFORE,
    allow_inside: str = ALLOW_INSIDE,
    need: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_entropy and spans (kind, start, end), in order."""
    scanner = Scanner(classes, allow, allow_before, allow_inside)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [scanner.scan(t.as_py() or "") for t in batch.column(text_col)]
        counts = [pa.array([sum(k == i for _, k, _ in x) for x in found], pa.int64()) for i in range(len(KINDS))]
        named = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found]
        return [*counts, pa.array(named, pa.list_(_ARROW_SPAN))]

    return annotate(docs, FIELDS, make, need)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", scanner: Scanner | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans count as one; null stays null."""
    scanner = scanner or Scanner()
    fields = [T.StructField(text_col, T.StringType())]

    def clean(text: str) -> str:
        out, at = [], 0
        for start, _, end in scanner.scan(text):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([None if not t.is_valid else clean(t.as_py()) for t in batch.column(text_col)], pa.string())]

    return annotate(docs, fields, make).select(*docs.columns)


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return scanned.withColumn("base_sha256", F.sha2(spans_text(base), 256)).withColumn("spans", spans_text(F.col("spans")))
