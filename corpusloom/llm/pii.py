"""Personal data, also where it is disguised, with offsets of the original text.

Detectors find e-mail addresses, IP addresses, payment cards and phone numbers. A chain of
transducers rewrites disguises (look-alike letters and digits, invisible characters, spelled
digits, `(at)`/`[dot]` and `name at host dot org`); each keeps an alignment, so that what the
detectors find in the rewritten text is mapped back to code points of the source. Spans of the
plain text always stay; the rewritten text can only add some.

Defined results: null and empty texts have no spans; equal texts equal spans; other columns,
also such of the same names, are ignored. Every step is linear in the text, however long runs of
letters or digits are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _io as io

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A digit run is only tried from its first digit: a match that began later would begin there too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            done = host.end()
            yield "email", start, done
        at = text.find("@", at + 1)


def detect(text: str) -> list[Span]:
    """Spans of the detectors on a text as it stands, by kind and then start."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "τ": "t", "υ": "u", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"plus": "+", "dot": ".", "point": ".", "dash": "-"}


def _single_forms() -> dict[str, str]:
    """Digits of every script, full-width and styled letters and signs, by their Unicode properties."""
    out = dict(LOOKALIKES)
    for at in (*range(0x660, 0xFF00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        c = chr(at)
        if (d := unicodedata.decimal(c, None)) is not None:
            out[c] = str(d)
        elif at >= 0xFF00 and len(x := unicodedata.normalize("NFKC", c)) == 1 and "!" <= x <= "~":
            out[c] = x
    return out


SINGLE = _single_forms()
_SINGLE_ANY = re.compile("[" + re.escape("".join(SINGLE)) + "]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_AT = re.compile(r"(?<!\s)\s*+[\[({<]\s*+(?:at|@|arroba|chez)\s*+[\])}>]\s*+|(?<=[A-Za-z0-9])(?:\s++@\s*+|@\s++|_at_|\s*+-at-\s*+)(?=[A-Za-z0-9])|&#64;|&#x40;|%40", re.IGNORECASE)
_DOT = re.compile(r"(?<!\s)\s*+[\[({<]\s*+(?:dot|\.|punto|point|punkt)\s*+[\])}>]\s*+|&#46;", re.IGNORECASE)
_BRACKETED = re.compile(r"[\[({<]\s*+(?:at|@|arroba|chez|dot|\.|punto|point|punkt)\s*+[\])}>]")
#: Words for the dot that stand without brackets; "point" and "chez" are ordinary words.
_DOT_WORDS = ("dot", "punto", "punkt")
#: The end of an address as it is said: the sign, and labels with their dots.
_SAID_HOST = re.compile(rf"(?<!\s)(?:\s++(?:at|arroba)\s++|\s*+@\s*+)[A-Za-z0-9-]++(?:(?:\s++(?:{'|'.join(_DOT_WORDS)})\s++|\s++\.\s++|\.)[A-Za-z0-9-]++)++", re.IGNORECASE)
_SAID_NUMBERS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s++dot\s++[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_SAID_PART = re.compile(rf"(?<!\s)\s++(at|arroba|@|{'|'.join(_DOT_WORDS)}|\.)\s++", re.IGNORECASE)
_SAID_SIGN = re.compile(rf"\s(?:at|arroba|@|{'|'.join(_DOT_WORDS)})\s")
#: Single characters with a blank between, an at sign among them.
_APART = re.compile(r"(?<!\S)(?:[A-Za-z0-9._%+-] )++@(?: [A-Za-z0-9.-](?![A-Za-z0-9]))++")
_SPOKEN = "|".join(sorted((*DIGIT_WORDS, *SIGN_WORDS), key=len, reverse=True))
_DIGIT_SPOKEN = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_RUN = re.compile(rf"(?<!\w)(?:(?:{_SPOKEN}|[0-9]++)(?!\w)[\s,-]*+){{4,}}", re.IGNORECASE)
_RUN_WORD = re.compile(rf"(?<!\w)(?:{_SPOKEN}|[0-9]++)(?!\w)", re.IGNORECASE)
# Cheap signs, on lower-cased text, that a transducer may apply.
_ANY_DIGIT = re.compile(rf"(?<!\w)(?:{_DIGIT_SPOKEN})(?!\w)")
_FAR_SCRIPTS = re.compile("[\u0370-\u1fff\u2460-\U0010ffff]")


class Aligned:
    """A text and, for each of its pieces, where in the source it comes from."""

    def __init__(self, text: str) -> None:
        self.text = text
        #: (start here, start in the source, end in the source, rewritten?) by start here
        self.pieces: list[tuple[int, int, int, bool]] = [(0, 0, len(text), False)]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span here, and whether a rewritten piece is in it."""
        first = bisect_right(self.pieces, start, key=lambda p: p[0]) - 1
        last = bisect_right(self.pieces, end - 1, key=lambda p: p[0]) - 1
        a, b = self.pieces[first], self.pieces[last]
        begin = a[1] if a[3] else a[1] + start - a[0]
        stop = b[2] if b[3] else b[1] + end - b[0]
        return begin, stop, any(p[3] for p in self.pieces[first : last + 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (sorted, apart from each other) of the text here."""
        if not edits:
            return
        out, pieces, at, length = [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal length
            i = bisect_right(self.pieces, a, key=lambda p: p[0]) - 1
            while a < b:
                here, source, to, changed = self.pieces[i]
                end = min(b, self.pieces[i + 1][0] if i + 1 < len(self.pieces) else len(self.text))
                pieces.append((length, source if changed else source + a - here, to if changed else source + end - here, changed))
                out.append(self.text[a:end])
                length += end - a
                a, i = end, i + 1

        for a, b, new in edits:
            keep(at, a)
            if new:
                begin, stop, _ = self.source(a, b)
                pieces.append((length, begin, stop, True))
                out.append(new)
                length += len(new)
            at = b
        keep(at, len(self.text))
        self.text, self.pieces = "".join(out), pieces or [(0, 0, 0, False)]


def _single(x: Aligned) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), SINGLE[m[0]]) for m in _SINGLE_ANY.finditer(x.text)]


def _invisible(x: Aligned) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "") for m in _INVISIBLE.finditer(x.text)]


def _signs(x: Aligned) -> list[tuple[int, int, str]]:
    return sorted([(m.start(), m.end(), "@") for m in _AT.finditer(x.text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(x.text)])


def _local_start(text: str, end: int, floor: int) -> int:
    """Where the local part that ends at `end` begins, its said dots included."""
    start = end
    while True:
        at = start if start == end else end
        while at > floor and text[at - 1] in _LOCAL:
            at -= 1
        if at == end:
            return start
        start = word_end = at
        while word_end > floor and text[word_end - 1].isspace():
            word_end -= 1
        word = word_end
        while word > floor and text[word - 1].isalpha():
            word -= 1
        end = word
        while end > floor and text[end - 1].isspace():
            end -= 1
        if word_end == start or end == word or text[word:word_end].lower() not in _DOT_WORDS:
            return start


def _said(x: Aligned) -> list[tuple[int, int, str]]:
    spans, floor = [m.span() for m in _SAID_NUMBERS.finditer(x.text)], 0
    for m in _SAID_HOST.finditer(x.text):
        start = _local_start(x.text, m.start(), floor)
        if start < m.start():
            spans.append((start, m.end()))
        floor = m.end()
    edits = {(a + p.start(), a + p.end(), "@" if p[1].lower() in ("at", "arroba", "@") else ".") for a, b in spans for p in _SAID_PART.finditer(x.text[a:b])}
    return sorted(edits)


def _apart(x: Aligned) -> list[tuple[int, int, str]]:
    return [(i, i + 1, "") for m in _APART.finditer(x.text) for i in range(m.start(), m.end()) if x.text[i] == " "]


def _spelled(x: Aligned) -> list[tuple[int, int, str]]:
    out = []
    for m in _RUN.finditer(x.text):
        found = list(_RUN_WORD.finditer(x.text, m.start(), m.end()))
        names = [f[0].lower() for f in found]
        if sum(n in DIGIT_WORDS for n in names) < 3:
            continue
        new = "".join(DIGIT_WORDS.get(n) or SIGN_WORDS.get(n) or n for n in names)
        out.append((found[0].start(), found[-1].end(), new))
    return out


_AT_SIGN = re.compile(r"\s@|@\s|[_-]at[_-]")


def _has_signs(low: str) -> object:
    return _AT_SIGN.search(low) or "&#" in low or "%40" in low or any(c in low and _BRACKETED.search(low) for c in "[({<")


#: (whether a transducer may apply to a lower-cased text, the transducer), in their order.
TRANSDUCERS: tuple[tuple[Callable[[str], object], Callable[[Aligned], list]], ...] = (
    (lambda low: not low.isascii() and _INVISIBLE.search(low), _invisible),
    (lambda low: not low.isascii() and _FAR_SCRIPTS.search(low), _single),
    (lambda low: " @ " in low, _apart),
    (_SAID_SIGN.search, _said),
    (_has_signs, _signs),
    (_ANY_DIGIT.search, _spelled),
)


def normalised(text: str) -> Aligned | None:
    """The text without disguises; None if there was none."""
    x, low = Aligned(text), text.lower()
    for applies, transducer in TRANSDUCERS:
        if applies(low) and (edits := transducer(x)):
            x.rewrite(edits)
            low = x.text.lower()
    return x if any(p[3] for p in x.pieces) or x.text != text else None


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(spans of the plain text, spans that only the rewritten text shows); code points."""
    text = text or ""
    base = detect(text)
    x = normalised(text) if text else None
    if x is None:
        return base, []
    known, added = set(base), []
    for kind, a, b in detect(x.text):
        start, end, _ = x.source(a, b)
        if (span := (kind, start, end)) not in known:
            known.add(span)
            added.append(span)
    return base, added


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the plain spans, base_sha256, spans, n_added, clean_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for value in batch.column(1):
                text = value.as_py()
                base, added = find(text)
                spans = base + added
                row = [sum(s[0] == k for s in base) for k in KINDS]
                row += [hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(added), masked(text, spans) if text and spans else text]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "clean_text"])

    return io.in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, clean_text string")


def mask_column(docs: DataFrame) -> DataFrame:
    """docs with the spans of their texts masked; n_chars, where there is one, follows the text."""
    columns = docs.columns
    at = columns.index("text")
    size = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            texts = [t.as_py() for t in arrays[at]]
            found = [find(t) for t in texts]
            clean = [masked(t, [*b, *a]) if b or a else t for t, (b, a) in zip(texts, found, strict=True)]
            if size is not None:
                sizes = [n if c is t else len(c) for n, t, c in zip(arrays[size].to_pylist(), texts, clean, strict=True)]
                arrays[size] = pa.array(sizes, arrays[size].type)
            arrays[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return io.in_batches(docs, run, docs.schema)
