"""Secrets, and credentials whose parts are told by standing together.

Base detectors find assignments, access keys and long hexadecimal runs. Besides, parts that
prove nothing alone are gathered: access identifiers, secret-like strings and endpoints. Each
has its scope: the block of text between blank lines, and in it REACH characters on either side.
An interval join links a secret-like string with the identifiers, endpoints and base findings whose
scopes reach it. The weak candidate is told where complementary parts co-occur:

* one of three classes of letters and 3.5 bits a letter next to an identifier, or to an endpoint
  and a base finding; an endpoint alone tells nothing, since links stand next to such strings;
* any other (`faint`: one class of letters is enough, 2.8 bits, 16 letters without a sign between)
  next to two kinds of parts, and not where it is part of an identifier or endpoint itself.

Every pair of a told secret and a partner in its scope is a link, and both become spans; spans that
overlap the other part are passed over. Parts have a length, so a scope holds so many at most, and
the pairs are linear in the parts, but for their order, however many a text has.

Defined results: null and empty texts have no spans; equal texts equal spans; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _io as io

BASE = ("assign", "access", "hex")
WEAK = ("identifier", "weak", "faint", "endpoint")
KINDS = BASE + WEAK
#: Characters on either side within which parts complement each other.
REACH = 240
Span = tuple[str, int, int]

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

_IDENTIFIER = re.compile(r"\b(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login|account|key_?id)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9._@-]++)|\b(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}", re.IGNORECASE)
_ID_HINT = re.compile(r"access_?key|client_?id|user|login|account|key_?id|asia|aida|aroa", re.IGNORECASE)
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"\b(?:https?|wss?|amqps?|postgres(?:ql)?|mysql|redis|mongodb|s3)://[^\s\"'<>]{3,}+|\b(?:host|endpoint|url|server)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9.-]{4,}+(?::[0-9]{2,5})?)", re.IGNORECASE)


_BREAK = re.compile(r"\n[ \t]*\r?\n")


def detect(text: str) -> list[Span]:
    """Base spans by start and then kind."""
    low = text.lower()
    out: list[Span] = []
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _likeness(s: str) -> str | None:
    """'weak' of a string of three classes of letters and 3.5 bits a letter; 'faint' of any other that
    isn't words or a path put together: 2.8 bits, and most of it one run without signs between."""
    bits = entropy(s)
    if bits >= 3.5 and all(re.search(p, s) for p in ("[a-z]", "[A-Z]", "[0-9]")):
        return "weak"
    return "faint" if bits >= 2.8 and max(map(len, re.split("[/_-]", s))) >= 16 else None


def parts(text: str) -> list[Span]:
    """Weak parts by start; empty unless both a secret-like string and a partner can be there."""
    out: list[Span] = [(kind, m.start(), m.end()) for m in _WEAK.finditer(text) if (kind := _likeness(m[0]))]
    if not out:
        return []
    if _ID_HINT.search(text):
        out += [("identifier", m.start(), m.end()) for m in _IDENTIFIER.finditer(text)]
    out += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


class _Side:
    """Spans by start and by end, to find those around a span that don't overlap it."""

    def __init__(self, spans: list[Span]) -> None:
        self.by_start, self.by_end = sorted(spans, key=lambda s: s[1]), sorted(spans, key=lambda s: s[2])
        self.starts, self.ends = [s[1] for s in self.by_start], [s[2] for s in self.by_end]
        self.reached = list(accumulate((s[2] for s in self.by_start), max))

    def near(self, part: Span, breaks: list[int]) -> list[Span]:
        """All spans before and after `part` within its scope."""
        before = self.by_end[bisect_left(self.ends, part[1] - REACH) : bisect_right(self.ends, part[1])]
        after = self.by_start[bisect_left(self.starts, part[2]) : bisect_right(self.starts, part[2] + REACH)]
        return [s for s in (*before, *after) if bisect_left(breaks, s[1]) == bisect_left(breaks, part[1])]

    def overlaps(self, part: Span) -> bool:
        at = bisect_left(self.starts, part[2])
        return at > 0 and self.reached[at - 1] > part[1]


def linked(text: str, base: list[Span]) -> list[tuple[Span, Span]]:
    """(weak secret, partner) pairs by secret, of secrets with complementary parts in scope: every
    identifier, endpoint and base finding there."""
    found = parts(text)
    if not found:
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    partners = {k: [s for s in found if s[0] == k] for k in ("identifier", "endpoint")} | {"base": base}
    side = {k: _Side(v) for k, v in partners.items()}
    out: list[tuple[Span, Span]] = []
    for secret in (s for s in found if s[0] in ("weak", "faint")):
        if side["base"].overlaps(secret):
            continue  # told already
        near = {k: n for k, x in side.items() if (n := x.near(secret, breaks))}
        if secret[0] == "faint":
            told = len(near) >= 2 and not side["identifier"].overlaps(secret) and not side["endpoint"].overlaps(secret)
        else:
            told = "identifier" in near or {"endpoint", "base"} <= near.keys()
        if told:
            out += [(secret, s) for spans in near.values() for s in spans]
    return sorted(out, key=lambda link: (link[0][1], link[1][1], KINDS.index(link[1][0])))


def find(text: str | None) -> tuple[list[Span], list[Span], list[tuple[Span, Span]]]:
    """(base spans, spans added by links, links)."""
    text = text or ""
    base = detect(text)
    links = linked(text, base)
    known, added = set(base), []
    for span in (s for link in links for s in link):
        if span not in known:
            known.add(span)
            added.append(span)
    return base, added, links


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans, base_sha256, spans, links (secret and partner spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(6))
            for value in batch.column(1):
                base, added, links = find(value.as_py())
                row = [sum(s[0] == k for s in base) for k in BASE]
                row += [hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), [listed([a]) + "~" + listed([b]) for a, b in links]]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "links"])

    return io.in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links array<string>")
