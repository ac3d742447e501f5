"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Normal form of a text: A-Z lower-cased, every separating byte a blank, words joined by single
blanks, one blank at either end. Each item gives its windows of consecutive words as patterns
` w1 w2 ... `, so a match always covers whole words. Each document is scanned once; the end of
a match is turned into a word number by counting blanks, and word numbers into code points of
the original text by walking its words.

A benchmark beyond MAX_PATTERN_CHARS is dealt to several automata as it is read; the documents are
then scanned once for each, so that a worker holds one of them at a time, and the hits are joined.

Defined results: null and empty texts have no words, no hits and are not contaminated; items
without words or without item_id give no pattern; rows that repeat an item_id are one item with
the windows of all of them; equal windows of several items count for each; equal documents give
equal rows; further columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _io as io
from . import _text as tx

WINDOW = 13
#: Characters of patterns in one automaton (about 40 bytes of memory each).
MAX_PATTERN_CHARS = 8_000_000

_TO_NORMAL = bytes((int(tx.FOLD[b]) if tx.ALNUM_ANY_CASE[b] else 0x20) for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, word_spans array<array<int>>, char_spans array<array<int>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_NORMAL).split()


def patterns_of(text: str | None, window: int = WINDOW) -> Iterator[tuple[str, int]]:
    """The windows of an item as patterns, with their number of words."""
    ws = normal_words(text)
    n = min(window, len(ws))
    for i in range(len(ws) - n + 1 if n else 0):
        yield f" {b' '.join(ws[i : i + n]).decode('utf-8', 'surrogatepass')} ", n


def automata(items: Iterable[tuple[str, str | None]], window: int = WINDOW, most: int | None = None) -> Iterator[ahocorasick.Automaton]:
    """Automata over the patterns of the items, each value (words, ids of items); one at a time."""
    machine, room = ahocorasick.Automaton(), MAX_PATTERN_CHARS if most is None else most
    whole = room
    for item_id, text in items:
        for pattern, n in patterns_of(text, window):
            ids = machine.get(pattern, (n, ()))[1]
            if item_id not in ids:
                machine.add_word(pattern, (n, (*ids, item_id)))
                room -= 0 if ids else len(pattern)
        if room <= 0:
            machine.make_automaton()
            yield machine
            machine, room = ahocorasick.Automaton(), whole
    if len(machine):
        machine.make_automaton()
        yield machine


def scan(text: str | None, machines: Iterable[ahocorasick.Automaton]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged spans of hit words (end exclusive), ids of items with a window here."""
    ws = normal_words(text)
    if not ws:
        return 0, [], set()
    line = f" {b' '.join(ws).decode('utf-8', 'surrogatepass')} "
    hits: list[tuple[int, int]] = []
    ids: set[str] = set()
    for machine in machines:
        at = blanks = 0
        for end, (n, who) in machine.iter(line):
            blanks += line.count(" ", at, end)  # blanks before `end`: the words up to there
            at = end
            hits.append((blanks - n, blanks))
            ids.update(who)
    return len(ws), merged(hits), ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code points of the original text."""
    if not spans:
        return []
    inside = [c >= "\x80" or bool(tx.ALNUM_ANY_CASE[ord(c)]) for c in text]
    begins = [i for i, x in enumerate(inside) if x and (i == 0 or not inside[i - 1])]
    ends = [i + 1 for i, x in enumerate(inside) if x and (i + 1 == len(inside) or not inside[i + 1])]
    return [(begins[a], ends[b - 1]) for a, b in spans]


def _scanned(docs: DataFrame, machine: ahocorasick.Automaton | None, every: bool) -> DataFrame:
    """Rows of SCHEMA and `tag` of docs (doc_id, tag, text) by one automaton; only hits unless `every`."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [shared.value] if shared.value is not None else []
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(6))
            for row, text in enumerate(batch.column(2)):
                text = text.as_py()
                n, spans, ids = scan(text, own)
                if every or spans:
                    for column, value in zip(out, (row, n, sum(b - a for a, b in spans), sorted(ids), spans, char_spans(text or "", spans)), strict=True):
                        column.append(value)
            yield _batch(batch, *out)

    return io.in_batches(docs, run, f"{SCHEMA}, tag long")


def _batch(batch: pa.RecordBatch, rows: list[int], n: list, hit: list, ids: list, spans: list, chars: list) -> pa.RecordBatch:
    pairs = pa.list_(pa.list_(pa.int32()))
    at = pa.array(rows, pa.int64())
    columns = [batch.column(0).take(at), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pairs), pa.array(chars, pairs), batch.column(1).take(at)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items", "word_spans", "char_spans", "tag"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row from the hits of several automata in a document: (doc_id, tag, n_words, lists)."""
    for batch in batches:
        n, *lists = (c.to_pylist() for c in batch.columns[2:])
        ids, spans, chars = ([[x for part in row or () for x in part] for row in column] for column in lists)
        words = [merged(x) for x in spans]
        yield _batch(batch, list(range(len(batch))), n, [sum(b - a for a, b in x) for x in words], [sorted(set(x)) for x in ids], words, [_merged_chars(x, y) for x, y in zip(spans, chars, strict=True)])


def _merged_chars(words: list, chars: list) -> list[tuple[int, int]]:
    """Character spans joined where their word spans touch or overlap."""
    out: list[list[int]] = []
    end = -1
    for (a, b), (x, y) in sorted(zip(map(tuple, words), map(tuple, chars), strict=True)):
        if out and a <= end:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
        end = max(end, b)
    return [(x, y) for x, y in out]


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, ids of the items found, hit spans in words and in code points.

    `docs` has doc_id and text, `items` item_id and text. The driver reads the items one by one into
    automata of MAX_PATTERN_CHARS; of these it holds one at a time.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) tag", "text")
    rows = ((str(r[0]), r[1]) for r in items.select("item_id", "text").toLocalIterator() if r[0] is not None)
    passes = []
    for machine in automata(rows, window):
        passes.append(_scanned(docs, machine, every=not passes))
    first = passes[0] if passes else _scanned(docs, None, every=True)
    if len(passes) < 2:
        return first.drop("tag")
    more = passes[1]
    for one in passes[2:]:
        more = more.union(one)
    lists = ["items", "word_spans", "char_spans"]
    # rows that repeat a document have the same hits: one of each automaton is enough
    more = more.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(*[F.collect_set(c).alias(f"_{c}") for c in ("items",)], F.collect_set(F.struct("word_spans", "char_spans")).alias("_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("tag").eqNullSafe(F.col("_tag"))
    none = F.array()
    both = first.join(more, same, "left").select(
        "doc_id",
        "tag",
        "n_words",
        F.concat(F.array("items"), F.coalesce("_items", none.cast("array<array<string>>"))).alias(lists[0]),
        *[F.concat(F.array(c), F.coalesce(F.col(f"_spans.{c}"), none.cast("array<array<array<int>>>"))).alias(c) for c in lists[1:]],
    )
    return io.in_batches(both, _joined, f"{SCHEMA}, tag long").drop("tag")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """find_overlaps with the decision: contaminated if at least a twentieth of the words is hit."""
    rule = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return find_overlaps(docs, items, window).withColumn("contaminated", rule)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
