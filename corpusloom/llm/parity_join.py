"""Similarity join on word n-gram sets by parity sketches.

A document's set holds its distinct word shingles: 4 words and a Jaccard similarity of 85 % unless
another Rule is given. Sets of at least that similarity differ in at most a fixed share of the sum
of their sizes (15/185 at 85 %). Sizes fall into bands; a set belongs to its own band, and visits
the next one if it can have partners there. A band has a bound k on the difference and cuts the
64-bit hash space of shingles into m > k ranges. The parity sketch of a range is the XOR of the
hashes in it. Each differing shingle changes one range only, so linked sets agree on m - k ranges
at least (pigeonhole). Ranges that are empty say nothing and are not sent; m leaves room for them,
and a set with more empty ranges than that (very rare) sends each of its shingles.

A bit sketch of the whole set (each hash toggles one bit of a number that grows with the set; it
folds to fewer bits by XOR) bounds the difference from below by its Hamming distance; candidates
that pass are verified on their texts. Texts are equal if the SHA-256 of their words is. Links are
used as they are found: equal texts first, then each set with the partner it shares most ranges
with, then each with the least document of another component that it shares most ranges with, and
at last, in ranges whose sets are not yet in one component, every pair of different components. So
groups of thousands of copies cost stars, not all pairs, and no link between components is lost.

Range keys travel as rows, one a batch where it has very many documents of a key, and meet in one
sorted stream a task. Near copies share very many ranges, so what follows counts the sets of documents
that meet under a key, each once with the number of its keys; sets above MOST documents stay rows of
their keys. A pair is verified in a stream sorted by its first document, which comes once
for so many partners. No step holds more than a batch and one document, or a block of sketches,
whatever the size of a group.

Defined results: null and empty texts and texts without words have the empty set and link with
nothing; texts of fewer words than a shingle have one, the whole; rows that repeat a doc_id are
that document, linked by any of their texts, each row with its own size; rows without doc_id keep
their size and have no component.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _io as io
from . import _text as tx

SHINGLE = 4
#: Jaccard threshold as a fraction: WHOLE * |A n B| >= LEAST * |A u B|.
LEAST, WHOLE = 85, 100
SKETCH_BITS = 512
#: Documents of a batch with one range key from which on only the least is sent to meet others.
HOT = 32
#: Documents under one range key that are told as one set.
MOST = 512
_BAND_RATIO = 1.5
_U64 = np.uint64
_SENT = "key long, doc_id long, center long, blob binary"
_MET = "kind int, key long, doc_id long, center long, n int, sketch binary, wide binary, docs array<long>"
#: The blob of a range key that some batch has told of very many documents.
_TOLD = b"+"
#: What a row about a document carries: kind, size, center; then its digest and bit sketch.
_HEAD = "<iiq"


@dataclass(frozen=True)
class Rule:
    """Words a shingle, and the least similarity as least / whole."""

    shingle: int = SHINGLE
    least: int = LEAST
    whole: int = WHOLE

    def __post_init__(self) -> None:
        if self.shingle < 1 or not 0 < self.least <= self.whole:
            raise ValueError("a shingle has one word at least, a similarity is above 0 and not above 1")

    def linked(self, common: int, a: int, b: int) -> bool:
        return a > 0 and b > 0 and self.whole * common >= self.least * (a + b - common)

    def most_difference(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes sum to `total`."""
        # J >= t  <=>  difference <= (1 - t) / (1 + t) * total
        return (self.whole - self.least) * total // (self.whole + self.least)


CONTRACT = Rule()


def linked(common: int, a: int, b: int, rule: Rule = CONTRACT) -> bool:
    return rule.linked(common, a, b)


@lru_cache(maxsize=8)
def bands(rule: Rule = CONTRACT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first size, size after the last, ranges m, room for empty ranges) of each band."""
    first, rows = 1, []
    while first < 1 << 40:
        after = max(first + 1, math.ceil(first * _BAND_RATIO))
        k = rule.most_difference(2 * (after - 1))
        if k == 0:
            rows.append((first, after, 0, 0))
        else:
            empty = k * math.exp(-first * rule.least / rule.whole / k)  # of the smallest set that visits
            room = math.ceil(empty + 3 * math.sqrt(empty)) + 1
            rows.append((first, after, k + 1 + room, room))
        first = after
    return tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, rule: Rule = CONTRACT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of the texts in turn, where each text's begin)."""
    size = rule.shingle
    w = tx.words(data, offsets, tx.SPACED, fold=True)
    counts = w.counts
    value = tx.windows(w.hash, size, 401)[tx.within(w.first, len(w.hash), size)]
    first = np.concatenate([[0], np.cumsum(np.maximum(0, counts - size + 1))])
    if len(short := np.flatnonzero((counts > 0) & (counts < size))):
        weights = tx.constants(size, 409)
        whole = [tx.mix(np.array([np.bitwise_xor.reduce(w.hash[w.first[d] : w.first[d + 1]] * weights[: counts[d]]) + _U64(counts[d])]))[0] for d in short]
        value = np.insert(value, first[short], np.array(whole, dtype=_U64))
        first = np.concatenate([[0], np.cumsum(np.where(counts >= size, counts - size + 1, counts > 0))])
    new = np.ones(len(value), dtype=bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            own = value[a:b]
            own.sort()
            new[a + 1 : b] = own[1:] != own[:-1]
    return value[new], np.concatenate([[0], np.cumsum(new)])[first]


def _xor_by(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduceat(values, begins) if len(begins) else np.zeros(0, _U64)


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bits of a set as bytes: twice as many bits as hashes, in powers of 2 from SKETCH_BITS on."""
    bits = max(SKETCH_BITS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else SKETCH_BITS
    at = (tx.mix(hashes) & _U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8))


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of fewer bits, `size` bytes of them, that the same set has."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches: the symmetric difference is no less."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def range_keys(hashes: np.ndarray, first: np.ndarray, rule: Rule = CONTRACT) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of the parity sketches of all ranges that aren't empty, for own and next band."""
    low, _, ranges, room = bands(rule)
    sizes = np.diff(first)
    home = np.searchsorted(low, sizes, side="right") - 1
    mixed = tx.mix(hashes)
    sets, keys = [], []
    for step in (0, 1):
        band = home + step
        comes = sizes > 0
        if step:
            # a partner of size s has at most s / least * whole shingles
            comes &= sizes * rule.whole // rule.least >= low[np.minimum(band, len(low) - 1)]
        m = np.where(comes, ranges[band], 0)
        used = np.flatnonzero(m > 0)
        if not len(used):
            continue
        take = np.repeat(m > 0, sizes)
        own = np.repeat(np.arange(len(sizes)), sizes)[take]
        part = ((hashes[take] >> _U64(32)) * m[own].astype(_U64)) >> _U64(32)
        joint = (own.astype(_U64) << _U64(32)) | part
        begins = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]]))
        xor = _xor_by(mixed[take], begins)
        who, where = own[begins], part[begins]
        key = tx.mix(xor ^ tx.mix((band[who].astype(_U64) << _U64(34)) + where + _U64(1)))
        sets.append(who)
        keys.append(key)
        full = np.bincount(who, minlength=len(sizes))
        rare = np.flatnonzero((m > 0) & (m - full > room[np.minimum(band, len(room) - 1)]))
        for d in rare:
            own_hashes = mixed[first[d] : first[d + 1]]
            sets.append(np.full(len(own_hashes), d))
            keys.append(tx.mix(own_hashes ^ _U64(0xA5A5A5A5A5A5A5A5) ^ tx.mix(np.array([band[d]], dtype=_U64))))
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    return np.concatenate(sets), np.concatenate(keys)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U64 else x.astype(np.int64), pa.int64())


def _send(rule: Rule) -> Callable:
    """Rows of range keys (odd; only the first of more than HOT a batch, _TOLD), of documents that met under
    a hot one in their batch (with the least of them as center), and of documents (even keys, with a blob): 0 new, its key
    the head of its digest; 2 a copy of one in the batch or without words; 3 without doc_id."""
    names, types = ["key", "doc_id", "center", "blob"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            seen: dict[bytes, int] = {}
            rows: tuple[list, list, list] = ([], [], [])
            key_parts, doc_parts = [], []

            def tell(key: int, doc: int | None, kind: int, n: int, center: int = 0, rest: bytes = b"", rows: tuple = rows) -> None:
                for column, value in zip(rows, (key & ~1, doc, struct.pack(_HEAD, kind, n, center) + rest), strict=True):
                    column.append(value)

            for row, to, data, at in tx.slices(batch.column(1)):
                hashes, first = shingle_sets(data, at, rule)
                sizes = np.diff(first).tolist()
                lower = tx.FOLD[data].tobytes()
                new = np.zeros(to - row, dtype=bool)
                for i, n in enumerate(sizes):
                    doc = int(ids[row + i])
                    if not known[row + i]:
                        tell(2 * (row + i), None, 3, n)
                        continue
                    digest = hashlib.sha256(b" ".join(lower[at[i] : at[i + 1]].split())).digest() if n else b""
                    if not n:
                        tell(doc, doc, 2, 0, doc)
                    elif digest in seen:
                        tell(doc, doc, 2, n, seen[digest])
                    else:
                        seen[digest], new[i] = doc, True
                        tell(int.from_bytes(digest[:8], "little", signed=True), doc, 0, n, 0, digest + bit_sketch(hashes[first[i] : first[i + 1]]).tobytes())
                sets, keys = range_keys(hashes, first, rule)
                sent = new[sets]
                key_parts.append(keys[sent] | _U64(1))
                doc_parts.append(ids[row + sets[sent]])
            parts = [(pa.array(rows[0], types[0]), pa.array(rows[1], types[1]), pa.nulls(len(rows[0]), types[2]), pa.array(rows[2], types[3]))]
            if key_parts:
                keys, docs = np.concatenate(key_parts), np.concatenate(doc_parts)
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                begins = np.ones(len(keys), dtype=bool)
                begins[1:] = keys[1:] != keys[:-1]
                lead = docs[begins][np.cumsum(begins) - 1]
                group = np.cumsum(begins) - 1
                hot = (np.bincount(group) > HOT)[group] if len(group) else begins
                sent = begins | ~hot
                told = pc.if_else(pa.array(hot[sent]), pa.scalar(_TOLD, types[3]), pa.scalar(None, types[3]))
                parts.append((_signed(keys[sent]), _signed(docs[sent]), pa.nulls(int(sent.sum()), types[2]), told))
                parts.append((_signed(keys[hot]), _signed(docs[hot]), _signed(lead[hot]), pa.nulls(int(hot.sum()), types[3])))
            for part in parts:
                yield from io.batches(pa.table(list(part), names=names), 1 << 14)

    return run


def _meet(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key and doc_id. kind 0 and 2: every document with the least one (2:
    one) of equal text; kind 1: (key, document, least document) of keys that more than `most`
    documents have, or very many of a batch; kind 4: the documents of another key that several have, in order;
    kind 3: rows without doc_id."""
    names = ["kind", "key", "doc_id", "center", "n", "sketch", "wide", "docs"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    def table(k: int, **columns: object) -> Iterator[pa.RecordBatch]:
        if k:
            yield from io.batches(pa.table([pa.array(columns[c], t) if c in columns else pa.nulls(k, t) for c, t in zip(names, types, strict=True)], names=names), 1 << 14)

    def of_keys(keys: np.ndarray, docs: np.ndarray, leads: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from table(len(keys), kind=np.ones(len(keys), np.int32), key=keys, doc_id=docs, center=leads)

    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # of the last key: itself, documents, _TOLD
    long_, lead = None, 0  # the last key that is told in rows, its least document

    def grouped(keys: np.ndarray, docs: np.ndarray, told: np.ndarray, more: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, long_, lead
        keys, docs, told = (np.concatenate(x) for x in zip(held, (keys, docs, told), strict=True))
        if not len(keys):
            return
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        end = len(keys)
        if more and end - first[-1] <= most:
            end, first = int(first[-1]), first[:-1]
        held = keys[end:], docs[end:], told[end:]
        if not len(first):
            return
        keys, docs, told = keys[:end], docs[:end], told[:end]
        size, leads = np.diff(first, append=end), docs[first]
        goes_on = keys[first] == long_ if long_ is not None else np.zeros(len(first), bool)
        leads[goes_on] = lead
        rows = goes_on | (size > most) | np.logical_or.reduceat(told, first)
        if rows[-1]:
            long_, lead = int(keys[-1]), int(leads[-1])
        each = np.repeat(rows & (goes_on | (size > 1)), size)
        yield from of_keys(keys[each], docs[each], np.repeat(leads, size)[each])
        sets = ~rows & (size > 1)
        at = np.concatenate([[0], np.cumsum(size[sets])])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(docs[np.repeat(sets, size)], pa.int64()))
        yield from table(len(lists), kind=np.full(len(lists), 4, np.int32), docs=lists)

    head, equal = None, {}  # the last digest head, least documents of its digests
    for batch in batches:
        blobs, met = batch.column(3), np.asarray(batch.column(2).is_valid())
        about = np.asarray(pc.fill_null(pc.greater(pc.binary_length(blobs), len(_TOLD)), False))
        keys, docs, leads = (np.asarray(batch.column(i).fill_null(0)).astype(np.int64) for i in range(3))
        yield from of_keys(keys[met], docs[met], leads[met])
        key_rows = ~about & ~met
        yield from grouped(keys[key_rows], docs[key_rows], np.asarray(blobs.is_valid())[key_rows], True)
        rows: tuple[list, ...] = tuple([] for _ in names[:-1])
        for i in np.flatnonzero(about).tolist():
            key, doc, blob = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), blobs[i].as_py()
            kind, n, center = struct.unpack_from(_HEAD, blob)
            sketch = wide = None
            if kind == 0:
                if key != head:
                    head, equal = key, {}
                center, wide = equal.setdefault(blob[16:48], doc), blob[48:]
                sketch = folded(np.frombuffer(wide, dtype=np.uint8), SKETCH_BITS // 8).tobytes()
            values = (kind, 0, doc, None if kind == 3 else center, n, sketch, wide)
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        yield from table(len(rows[0]), **dict(zip(names, rows, strict=False)))
    yield from grouped(*(x[:0] for x in held), False)


#: Partners that are verified next to one copy of a document's text; more get another copy.
PARTNERS = 512


def _verify(rule: Rule) -> Callable:
    """Pairs (a, b) of linked sets from rows (a, salt, part, doc_id, text) in their order: the texts
    of a (part 0), then its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        firsts: list[np.ndarray] = []
        for batch in batches:
            a, salt, part, doc = (np.asarray(batch.column(i)) for i in range(4))
            good = np.zeros(len(batch), dtype=bool)
            for row, to, data, offsets in tx.slices(batch.column(4)):
                hashes, first = shingle_sets(data, offsets, rule)
                for i in range(row, to):
                    if (a[i], salt[i]) != at:
                        at, firsts = (a[i], salt[i]), []
                    own = hashes[first[i - row] : first[i - row + 1]]
                    if part[i] == 0:
                        firsts.append(own.copy())
                    else:
                        good[i] = any(rule.linked(_common(x, own), len(x), len(own)) for x in firsts)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(doc)], names=["a", "b"]).filter(pa.array(good))

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if not len(x) or not len(y):
        return 0
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def _near(rule: Rule) -> Callable:
    """As _verify, pairs whose sketches let them be linked, from rows (a, salt, part, doc_id, n, wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        firsts: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            a, salt, part, doc, n = (np.asarray(batch.column(i)) for i in range(5))
            good = np.zeros(len(batch), dtype=bool)
            for i, wide in enumerate(batch.column(5)):
                if (a[i], salt[i]) != at:
                    at, firsts = (a[i], salt[i]), []
                own = np.frombuffer(wide.as_py(), dtype=np.uint8)
                if part[i] == 0:
                    firsts.append((int(n[i]), own))
                else:
                    good[i] = any(rule.linked(min(k, int(n[i])), k, int(n[i])) and apart(x, own) <= rule.most_difference(k + int(n[i])) for k, x in firsts)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(doc)], names=["a", "b"]).filter(pa.array(good))

    return run


def _beside(rows: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(a, salt, part, doc_id, columns of rows): each document of `rows` as an `a` (part 0) or next
    to one, in the order of a, salt and part; at most PARTNERS partners a salt.

    `pairs` is a written table of distinct pairs. Up to `most` of them (24 bytes each) are counted
    and broadcast to the rows; beyond that the join is shuffled.
    """
    few = pairs.limit(most + 1).count() <= most
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("_s"))
    dealt = pairs.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_s")).cast("int").alias("salt"), F.col("b").alias("doc_id"))
    heads = heads.select(F.col("a").alias("doc_id"), "_s")
    first = rows.join(F.broadcast(heads) if few else heads, "doc_id")
    first = first.select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("salt"), F.lit(0).alias("part"), *rows.columns)
    rest = rows.join(F.broadcast(dealt) if few else dealt, "doc_id").select("a", "salt", F.lit(1).alias("part"), *rows.columns)
    return first.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", "part")


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, rule: Rule = CONTRACT, most: int = 1_000_000) -> DataFrame:
    """The pairs (a, b), of a written table, whose sets are linked: by their sketches (`sets`: doc_id,
    n, wide) first, then by the texts themselves."""
    near = io.in_batches(_beside(sets, pairs, most), _near(rule), "a long, b long")
    near = io.written(near.distinct(), "near")
    return io.in_batches(_beside(docs.select("doc_id", "text"), near, most), _verify(rule), "a long, b long")


#: Sets of one range that a task compares with one another; larger groups are cut into blocks.
BLOCK = 2048


def _compare(rule: Rule) -> Callable:
    """Pairs of different components within each group (key, i, j) that bit sketches let pass."""
    least, whole = rule.least, rule.whole

    def of(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(group) < 2:
            return
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs, comps, sizes = (np.array([x[k] for x in group], dtype=np.int64) for k in (0, 1, 2))
        bits = np.frombuffer(b"".join(x[3] for x in group), dtype=np.uint64).reshape(len(group), -1)
        for i in range(len(group) - 1):
            other = np.flatnonzero(comps[i + 1 :] != comps[i]) + i + 1
            other = other[(np.minimum(sizes[other], sizes[i]) * whole >= least * np.maximum(sizes[other], sizes[i]))]
            if len(other):
                away = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1).astype(np.int64)
                other = other[away <= (whole - least) * (sizes[other] + sizes[i]) // (whole + least)]
            if len(other):
                held.append((np.minimum(docs[other], docs[i]), np.maximum(docs[other], docs[i])))
            if held and (len(held) >= 1024 or i == len(group) - 2):
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                held = []
                yield from io.batches(pa.table([_signed(a), _signed(b)], names=["a", "b"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            for key, i, j, doc, comp, n, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != at:
                    yield from of(group)
                    at, group = (key, i, j), []
                group.append((doc, comp, n, sketch))
        yield from of(group)

    return run


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component (its least doc_id) of each document that the edges (a, b) name.

    Each round lets every node point at its least neighbour, follows the pointers to their roots
    and contracts the graph to these; a star is done in one round.
    """
    edges = io.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    total = None
    while not edges.isEmpty():
        # b is the greater end: its least neighbour is less than itself; the least of a component has none
        up = edges.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("component"))
        roots = edges.select(F.col("a").alias("doc_id")).distinct().join(up, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("component"))
        point = io.written(up.union(roots), "pointers")
        while True:
            then = point.select(F.col("doc_id").alias("component"), F.col("component").alias("_next"))
            jumped = io.written(point.join(then, "component").select("doc_id", F.col("_next").alias("component"), (F.col("_next") != F.col("component")).alias("_moved")), "pointers")
            point = jumped.select("doc_id", "component")
            if jumped.where("_moved").isEmpty():
                break
        if total is None:
            total = point
        else:
            then = point.select(F.col("doc_id").alias("component"), F.col("component").alias("_next"))
            total = io.written(total.join(then, "component", "left").select("doc_id", F.coalesce("_next", "component").alias("component")), "components")
        to = point.select(F.col("doc_id").alias("a"), F.col("component").alias("_a"))
        then = point.select(F.col("doc_id").alias("b"), F.col("component").alias("_b"))
        edges = edges.join(to, "a").join(then, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a <> b").distinct()
        edges = io.written(edges, "edges")
    return total if total is not None else edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    then = merged.select(F.col("doc_id").alias("component"), F.col("component").alias("_next"))
    return labels.join(then, "component", "left").select("doc_id", F.coalesce("_next", "component").alias("component"))


def similarity_components(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    sent = io.in_batches(docs, _send(rule), _SENT)
    dealt = sent.repartition(F.when(F.col("center").isNull(), F.col("key")).otherwise(F.xxhash64("key", "doc_id")))
    met = io.written(io.in_batches(dealt.sortWithinPartitions("key", "doc_id"), partial(_meet, most=MOST), _MET), "ranges")
    sets = met.where("kind in (0, 2, 3)")
    together = io.written(met.where("kind = 4").groupBy("docs").agg(F.count("*").alias("votes")), "together")
    together = together.select(F.xxhash64("docs").alias("key"), F.explode("docs").alias("doc_id"), F.get("docs", F.lit(0)).alias("center"), "votes")
    shared = met.where("kind = 1").select("key", "doc_id", "center", F.lit(1).cast("long").alias("votes")).union(together)
    equal = sets.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b"))

    wide = sets.where("kind = 0").select("doc_id", "n", "wide").distinct()  # a doc_id may have several texts

    def starred(votes: DataFrame) -> DataFrame:
        """Each document with the center that most of its votes (doc_id, center, votes) name."""
        votes = votes.groupBy("doc_id", "center").agg(F.sum("votes").alias("count"))
        best = votes.groupBy("doc_id").agg(F.min_by("center", F.struct(-F.col("count"), F.col("center"))).alias("a"))
        return io.written(best.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct(), "stars")

    def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components after the linked ones of `pairs` are joined too."""
        found = io.written(verified(docs, wide, pairs, rule), "links")
        to = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("_a"))
        then = labels.select(F.col("doc_id").alias("b"), F.col("component").alias("_b"))
        more = found.join(to, "a", "left").join(then, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        joined = components(more)
        whole = labels.union(joined.select("doc_id", F.col("doc_id").alias("component")).join(labels.select("doc_id"), "doc_id", "left_anti"))
        return io.written(_relabelled(whole, joined), "labels")

    def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members (key, doc_id, votes) of the ranges whose sets are still in several components."""
        here = members.join(labels, "doc_id", "left").select("key", "doc_id", "votes", F.coalesce("component", "doc_id").alias("component"))
        here = io.written(here, "members")
        open_ = here.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("_hi"), F.count("*").alias("size")).where("least <> _hi")
        return io.written(here.join(open_.select("key", "least", "size"), "key"), "open")

    star = starred(shared.where("doc_id <> center").select("doc_id", "center", "votes"))
    labels = components(equal.union(io.written(verified(docs, wide, star, rule), "links")))
    group = labelled(shared.select("key", "doc_id", "votes"), labels)
    # the least document of a component stands for it
    second = starred(group.where("component <> least").select("doc_id", F.col("least").alias("center"), "votes")).join(star, ["a", "b"], "left_anti")
    second = io.written(second, "stars")
    if not second.isEmpty():
        labels = merged(labels, second)
        group = labelled(group.select("key", "doc_id", "votes"), labels)

    sketches = sets.where("kind = 0").select("doc_id", "n", "sketch").distinct()
    group = group.drop("votes").distinct().join(sketches, "doc_id").withColumn("_s", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("_s")).cast("int")
    group = group.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    group = group.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "doc_id", "component", "n", "sketch")
    pairs = io.in_batches(group.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "component", "doc_id"), _compare(rule), "a long, b long")
    pairs = io.written(pairs.distinct().join(star.union(second), ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        labels = merged(labels, pairs)
    return sets.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
