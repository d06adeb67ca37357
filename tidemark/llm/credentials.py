"""Secrets in texts: named assignments, access keys, long hex numbers, and strings too random to be words.

Base spans are pattern matches: ``assign`` (a name such as password or token, a separator, a value
of 8 characters or more), ``access`` (AKIA and capitals or digits, 16 or more in all), ``hex`` (32
hex digits or more). They stay whatever else is found.

Entropy adds spans. Candidates are strings of 20 characters or more of the base64 alphabets. Inside
one, each run of a character class at least as long as the class's window is read by a window that
slides a character at a time: the count of the character that leaves and of the one that enters
change, and with them the sum of c*log2(c) over the window's counts c, kept in whole numbers so that
no error adds up. Shannon entropy is log2(w) minus that sum over w. Where it reaches the class's
limit the window counts, and windows that touch become one span. The limits part random strings
from text and numbers: digits alone can't reach the limit of hex, and base64 must hold both cases and
a digit.

A span is suppressed if a pattern of the allow list is found in its candidate with the 24 characters
before it: placeholders, alphabets, addresses, inline data and declared digests. Base spans are not.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; spans of
several kinds may overlap; texts of any length are read whole, one at a time; repeated rows and rows
without an id each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import text_parts

# Fixed patterns of the base spans.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"


class CharClass(NamedTuple):
    kind: str
    chars: str  # of a regular expression's class
    window: int
    bits: float  # entropy of a window, at least
    holds: tuple[str, ...] = ()  # each found in the span


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 32, 3.35, ("[A-Fa-f]", "[0-9]")),
    CharClass("entropy_upper", "A-Z0-9", 20, 3.7, ("[A-Z]", "[0-9]")),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", 32, 4.3, ("[a-z]", "[A-Z]", "[0-9]")),
)
#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
ALLOWED = (
    r"(?i)example|placeholder|changeme|dummy|your[_-]",
    r"(.)\1{7}",
    r"(?i)abcdefghij|0123456789",
    r"(?i)\b(?:https?|ftp)://|\bwww\.",
    r"(?i)\bdata:[a-z]+/[a-z0-9.+-]+;base64,",
    r"(?i)\bsha(?:1|224|256|384|512)[-:]|\bmd5[-:]|\bcommit ",
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
BEFORE, UNIT = 24, 1 << 20

SCHEMA = "id long, spans array<struct<kind: string, start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def dense(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """The stretches of text (of one class) whose windows have an entropy of bits or more."""
    cost = [0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))]
    most = window * (math.log2(window) - bits) * UNIT
    counts: dict[str, int] = {}
    total, found = 0, []
    for i, c in enumerate(text):
        if i >= window:
            k = counts[gone := text[i - window]]
            counts[gone], total = k - 1, total + cost[k - 1] - cost[k]
        k = counts.get(c, 0)
        counts[c], total = k + 1, total + cost[k + 1] - cost[k]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if found and found[-1][1] >= start:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


class Scanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.assign, self.access, self.hex, self.candidate = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX), re.compile(CANDIDATE)
        self.classes = [(c, re.compile(f"[{c.chars}]{{{c.window},}}"), [re.compile(x) for x in c.holds]) for c in classes]
        self.allowed = [re.compile(x) for x in allowed]
        self.order = {k: i for i, k in enumerate((*KINDS[:3], *(c.kind for c in classes)))}

    def base(self, text: str) -> Iterator[tuple[str, int, int]]:
        low = text.lower()
        if any(x in low for x in ("passw", "secret", "token", "key")):
            yield from (("assign", *m.span()) for m in self.assign.finditer(text) if len(m[2]) >= 8)
        yield from (("access", *m.span()) for m in self.access.finditer(text))
        yield from (("hex", *m.span()) for m in self.hex.finditer(text))

    def random(self, text: str) -> Iterator[tuple[str, int, int]]:
        for m in self.candidate.finditer(text):
            seen = text[max(0, m.start() - BEFORE) : m.end()]
            if any(x.search(seen) for x in self.allowed):
                continue
            for c, pattern, holds in self.classes:
                for run in pattern.finditer(m[0]):
                    for start, end in dense(run[0], c.window, c.bits):
                        if all(x.search(run[0], start, end) for x in holds):
                            at = m.start() + run.start()
                            yield c.kind, at + start, at + end

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return sorted([*self.base(text), *self.random(text)], key=lambda x: (x[1], self.order[x[0]]))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(id_col, spans) of each row: (kind, start, end) by start, then by kind."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for rows, texts in text_parts(batches):
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scanner.spans(t.decode())] for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, _SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(found, SCHEMA).withColumnRenamed("id", id_col)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each stretch that spans cover replaced by mark."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("out"))
    step = lambda x, s: F.when(
        s["start"] >= x["end"], F.struct(s["end"].alias("end"), F.concat(x["out"], F.substr(text, (x["end"] + 1).cast("int"), (s["start"] - x["end"]).cast("int")), F.lit(mark)).alias("out"))
    ).otherwise(F.struct(F.greatest(x["end"], s["end"]).alias("end"), x["out"].alias("out")))
    return F.aggregate(spans, start, step, lambda x: F.concat(x["out"], F.substr(text, (x["end"] + 1).cast("int"))))
