"""Secrets: assignments, access keys and hex strings by pattern, others by entropy.

Candidate strings are the maximal runs of characters that keys are written in. For each
character class a window slides over the runs of that class inside a candidate, and its
Shannon entropy follows from two changes of one count each: with counts c of the W
characters in it the entropy is log2 W - (sum of c log2 c) / W, and that sum is kept in
integers (2^-32), so that nothing drifts. Windows of enough entropy that hold letters and
digits are joined to spans, of which those stay that no rule of the allow list covers:
candidates that are as a whole of a known harmless form, and spans with a word of a placeholder or a run
of successive characters. Suppression concerns these spans alone; a value that a pattern finds as well has both.

Each text is scanned on its own, from end to end, in time linear in its length; nothing is
shuffled.

Defined cases: a null text is an empty one (`redact` leaves it null). Spans count code points,
the end excluded; kinds are matched independently and may overlap. Repeated rows, and rows with a null
doc_id, have their own results. Columns of other names pass through `redact`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import log2
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: One of these, in lower case, is in every text with an assignment.
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_CANDIDATE = 6, 20
#: Runs of at least the length that counts. As they are maximal, a longer pattern finds what is left of all runs.
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}+")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")


class CharacterClass(NamedTuple):
    name: str
    run: re.Pattern
    window: int
    #: Least bits a character.
    entropy: float


CLASSES = (
    CharacterClass("hex", re.compile(r"(?:[0-9a-f]{20,}|[0-9A-F]{20,})"), 20, 3.0),
    CharacterClass("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.0),
)
#: Candidates of these forms as a whole are no secrets: UUIDs, dates and versions, paths and names of lower-case words, mere numbers.
ALLOWED_FORMS = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+/_.=-]+",
    r"[.-]*(?:[a-z]+[0-9]{0,2}|[0-9]{1,4})(?:[/_.=-]+(?:[a-z]+[0-9]{0,2}|[0-9]{1,4}))*[/_.=-]*",
)
ALLOWED_WORDS = ("example", "placeholder", "changeme", "dummy", "xxxx", "0000000", "12345678", "abcdefgh")

_UNIT = 1 << 32
#: c log2 c in units; for a moment a window holds one character more.
_CLOG = [0, *(round(c * log2(c) * _UNIT) for c in range(1, max(k.window for k in CLASSES) + 2))]


class AllowList:
    """What is known to be harmless."""

    def __init__(self, forms: Iterable[str] = ALLOWED_FORMS, words: Iterable[str] = ALLOWED_WORDS):
        self.form = re.compile("|".join(f"(?:{f})" for f in forms) or r"(?!)")
        self.words = tuple(w.lower() for w in words)

    def whole(self, candidate: str) -> bool:
        return self.form.fullmatch(candidate) is not None

    def part(self, span: str) -> bool:
        low = span.lower()
        return any(w in low for w in self.words)


def dense(run: str, kind: CharacterClass) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run whose windows all have the entropy, a letter and a digit; parts that touch are one."""
    w, found = kind.window, []
    most = round((log2(w) - kind.entropy) * w * _UNIT)
    counts: dict[str, int] = {}
    total = digits = letters = 0
    for i, c in enumerate(run):
        n = counts.get(c, 0) + 1
        counts[c] = n
        total += _CLOG[n] - _CLOG[n - 1]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= w:
            old = run[i - w]
            n = counts[old] - 1
            counts[old] = n
            total -= _CLOG[n + 1] - _CLOG[n]
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= w - 1 and total <= most and digits and letters:
            if found and i - w + 1 <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i - w + 1, i + 1))
    return found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of which those that overlap are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(text: str | None, allow: AllowList) -> list[tuple[int, int, int]]:
    """(start, number of its kind, end) of each secret, by start, then kind."""
    text, base, added = text or "", [], []
    low = text.lower()
    if any(w in low for w in ASSIGNED):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    for m in CANDIDATE.finditer(text):
        at, candidate = m.start(), m[0]
        base += [(at + x.start(), k, at + x.end()) for k, pattern in ((1, ACCESS), (2, HEX)) for x in pattern.finditer(candidate)]
        if allow.whole(candidate):
            continue
        spans = [(x.start() + a, x.start() + b) for kind in CLASSES for x in kind.run.finditer(candidate) for a, b in dense(x[0], kind)]
        added += [(at + a, at + b) for a, b in joined(spans) if not allow.part(candidate[a:b])]
    return sorted(base + [(a, 3, b) for a, b in added])


def secrets(text: Column, allow: AllowList | None = None) -> Column:
    """array<struct<start, kind, end>> of a text's secrets, by start, then kind as in KINDS."""
    allow = allow or AllowList()

    @F.pandas_udf("array<struct<start:int,kind:string,end:int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in find(t, allow)] for t in batch])

    return of(text)


def mask(text: str | None, allow: AllowList) -> str | None:
    """The text with each secret replaced by [SECRET]; those that overlap are one."""
    if not text:
        return text
    parts, done = [], 0
    for a, b in joined([(a, b) for a, _, b in find(text, allow)]):
        parts += [text[done:a], "[SECRET]"]
        done = b
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, into: str = "text", allow: AllowList | None = None) -> DataFrame:
    """docs with the secrets of their texts masked in column `into`."""
    allow = allow or AllowList()

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([mask(t, allow) for t in batch], dtype=object)

    return docs.withColumn(into, masked(F.col("text")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", secrets(F.col("text")).alias("all"))
    named = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("all", lambda s: s["kind"] != KINDS[-1])
    return found.select("doc_id", *(named(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))
