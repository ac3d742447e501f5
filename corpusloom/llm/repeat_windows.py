"""Removal of repeated word windows by level-wise doubling.

To find every repeated window of `length` words without shuffling a row for each position:

1. Level `length // 2`. Of each window of full length, only its least half-length window (by
   hash; all of them on ties) is looked at. Equal full windows have equal least halves at the
   same place, so no repeat is lost, and about one position in six is sent.
2. Only full windows all of whose least halves occur more than once are extended to twice the
   length; these are compared by a 128-bit BLAKE2 digest of their words. Of equal ones all but the
   first are repeats.
3. The words that repeats cover are taken out of the texts.

Before each exchange the equal windows of one batch are reduced to their first; the others are
known to be repeats there and then. So a passage that a third of all documents share sends one
row a batch, not one a document. Positions travel in blobs of columns, one a bucket and batch.

`longest_repeats` goes on doubling: a window of 40 words repeats if the windows of 20 at its two
halves do so together, and so on until no candidate is left.

Defined results: null and empty texts have no words; a row without doc_id is returned as it is,
never compared; rows that repeat a doc_id with the same text are one document; several texts of
one doc_id are documents of their own, in the order of a hash of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _io as io
from . import _text as tx

LENGTH = 20
_U64 = np.uint64
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SENT = "bucket int, doc_id long, tag int, blob binary"
_FOUND = "doc_id long, tag int, blob binary"
_NAMES = ["bucket", "doc_id", "tag", "blob"]
#: Columns of a blob of windows: key, document, its tag (of the text), position, check.
_KINDS = (np.uint64, np.int64, np.int32, np.uint32, np.uint64)


def _halves(hashed: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each half window, least half of each full window, is the full window in one text?)."""
    half = length // 2
    h = tx.windows(hashed, half, 101)
    ok = tx.within(first, len(hashed), length)
    least = tx.sliding(h, length - half + 1, np.minimum)
    return h, least[: len(ok)], ok


def _anchors(h: np.ndarray, least: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Positions of half windows that are the least of some full window within a text."""
    reach = np.concatenate([np.zeros(width - 1, _U64), np.where(ok, least, _U64(0)), np.zeros(width - 1, _U64)])
    best = tx.sliding(reach, width, np.maximum)[: len(h)]
    # a position is an anchor if a window that covers it has it as its least
    valid = np.concatenate([np.zeros(width - 1, bool), ok, np.zeros(width - 1, bool)])
    any_ok = tx.sliding(valid.view(np.uint8), width, np.maximum)[: len(h)].astype(bool)
    return np.flatnonzero(any_ok & (best == h))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and the tag of the text."""
    return tuple(np.asarray(batch.column(i).fill_null(0)).astype(k) for i, k in ((0, np.int64), (1, np.int32)))


def _firsts(keys: np.ndarray, check: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, check, document, tag, position; where in that order a new key and check begin)."""
    order = np.lexsort((*reversed(place), check, keys))
    k, c = keys[order], check[order]
    begins = np.ones(len(k), dtype=bool)
    begins[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, begins


def _marks(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(document, tag, its positions in order)."""
    if not len(ids):
        return
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos = ids[order], tags[order], pos[order].astype(np.uint32)
    cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
        yield int(ids[a]), int(tags[a]), pos[a:b].tobytes()


class _Sender:
    """Collects (bucket, doc_id, tag, blob) rows: windows for a bucket, or marks (bucket below 0)."""

    def __init__(self, n_buckets: int) -> None:
        self.n, self.rows = n_buckets, ([], [], [], [])

    def _add(self, *row: object) -> None:
        for column, value in zip(self.rows, row, strict=True):
            column.append(value)

    def windows(self, keys: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, check: np.ndarray | None = None) -> None:
        bucket = (keys % _U64(self.n)).astype(np.int64)
        columns = [(x, k) for x, k in zip((keys, ids, tags, pos, check), _KINDS, strict=True) if x is not None]
        for b, rows in io.split_by(bucket):
            self._add(b, len(rows), 0, b"".join(x[rows].astype(k, copy=False).tobytes() for x, k in columns))

    def marks(self, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> None:
        for doc, tag, blob in _marks(ids, tags, pos):
            self._add(-1 - (doc % self.n), doc, tag, blob)

    def batch(self) -> Iterator[pa.RecordBatch]:
        out = pa.table([pa.array(c, k) for c, k in zip(self.rows, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=_NAMES)
        yield from io.batches(out, 512)


def _send_halves(length: int, n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids, tags = _ids(batch)
            parts = []
            for row, _, data, at in tx.slices(batch.column(2)):
                w = tx.words(data, at, tx.SPACED)
                if len(w.hash) < length:
                    continue
                h, least, ok = _halves(w.hash, w.first, length)
                own = tx.owner(w.first)
                a = _anchors(h, least, ok, length - length // 2 + 1)
                parts.append((h[a], ids[row + own[a]], tags[row + own[a]], a - w.first[own[a]]))
            if not parts:
                continue
            keys, doc, tag, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, begins = _firsts(keys, np.zeros(len(keys), np.uint8), doc, tag, pos)
            keys, doc, tag, pos = keys[order], doc[order], tag[order], pos[order]
            group = np.cumsum(begins) - 1
            size = np.bincount(group)
            several = size[group] > 1
            send = _Sender(n_buckets)
            send.marks(doc[several], tag[several], pos[several])
            # the highest bit of a position: several of this batch have the key, all of them marked
            known = (size[group[begins]] > 1).astype(np.uint32) << np.uint32(31)
            send.windows(keys[begins], doc[begins], tag[begins], pos[begins].astype(np.uint32) | known)
            yield from send.batch()

    return run


def _digests(words: list[bytes], places: np.ndarray, length: int) -> np.ndarray:
    """128 bits, as two columns, of the words from each place on."""
    found = b"".join(hashlib.blake2b(b" ".join(words[i : i + length]), digest_size=16).digest() for i in places.tolist())
    return np.frombuffer(found, dtype=_U64).reshape(-1, 2)


def _send_full(length: int, n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts without a mark are passed over here, not in the plan: so both joins of this
            # operator read one and the same exchange of the texts
            batch = batch.filter(pc.and_(batch.column(3).is_valid(), batch.column(0).is_valid()))
            ids, tags = _ids(batch)
            marks = batch.column(3)
            parts = []
            for row, to, data, at in tx.slices(batch.column(2)):
                w = tx.words(data, at, tx.SPACED)
                if len(w.hash) < length:
                    continue
                h, least, ok = _halves(w.hash, w.first, length)
                again = np.zeros(len(h), dtype=bool)
                for i in range(to - row):
                    for blob in marks[row + i].as_py() or ():
                        where = w.first[i] + np.frombuffer(blob, dtype=np.uint32).astype(np.int64)
                        again[where[where < len(h)]] = True
                kept = tx.sliding(np.where(again, h, _TOP), length - length // 2 + 1, np.minimum)[: len(ok)]
                at_ = np.flatnonzero(ok & (kept == least))
                own = tx.owner(w.first)[at_]
                raw, place = data.tobytes(), at_ - w.first[own]
                for i in np.unique(own).tolist():
                    here = place[np.searchsorted(own, i) : np.searchsorted(own, i + 1)]
                    found = _digests(raw[at[i] : at[i + 1]].split(), here, length)
                    parts.append((found[:, 0], found[:, 1], np.full(len(here), ids[row + i]), np.full(len(here), tags[row + i]), here))
            if not parts:
                continue
            keys, check, doc, tag, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, begins = _firsts(keys, check, doc, tag, pos)
            first = order[begins]
            rest = order[~begins]
            # equal starts of a repeated row are one start, not a repeat
            lead = first[np.cumsum(begins) - 1][~begins]
            rest = rest[(doc[rest] != doc[lead]) | (tag[rest] != tag[lead]) | (pos[rest] != pos[lead])]
            send = _Sender(n_buckets)
            send.marks(doc[rest], tag[rest], pos[rest])
            send.windows(keys[first], doc[first], tag[first], pos[first], check[first])
            yield from send.batch()

    return run


def _unpack(blobs: list[tuple[int, bytes]], kinds: tuple) -> tuple[np.ndarray, ...]:
    columns: tuple[list, ...] = tuple([] for _ in kinds)
    for n, blob in blobs:
        at = 0
        for column, kind in zip(columns, kinds, strict=True):
            size = n * np.dtype(kind).itemsize
            column.append(np.frombuffer(blob[at : at + size], dtype=kind))
            at += size
    return tuple(np.concatenate(x) for x in columns)


def _meet(last: bool) -> Callable:
    """Of the windows of a bucket: at the last level the repeats but the first, before it all."""

    def of(blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if last:
            keys, doc, tag, pos, check = _unpack(blobs, _KINDS)
            order, begins = _firsts(keys, check, doc, tag, pos)
            lead = order[begins][np.cumsum(begins) - 1]
            chosen = order[(doc[order] != doc[lead]) | (tag[order] != tag[lead]) | (pos[order] != pos[lead])]
        else:
            keys, doc, tag, pos = _unpack(blobs, _KINDS[:-1])
            known, pos = pos >> np.uint32(31), pos & np.uint32(0x7FFFFFFF)
            order, begins = _firsts(keys, np.zeros(len(keys), np.uint8), doc, tag, pos)
            group = np.cumsum(begins) - 1
            # a window whose batch held several was marked there already
            chosen = order[(np.bincount(group)[group] > 1) & (known[order] == 0)]
        found = list(zip(*_marks(doc[chosen], tag[chosen], pos[chosen]), strict=True))
        if found:
            yield from io.batches(pa.table([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=_NAMES[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            marks = batch.filter(pc.less(batch.column(0), 0))
            if len(marks):
                yield marks.select(_NAMES[1:])
            for b, n, _, blob in zip(*(x.to_pylist() for x in batch.filter(pc.greater_equal(batch.column(0), 0)).columns), strict=True):
                if b != bucket and held:
                    yield from of(held)
                    held = []
                bucket = b
                held.append((n, blob))
        if held:
            yield from of(held)

    return run


def _marked(docs: DataFrame, sent: DataFrame, last: bool) -> DataFrame:
    """docs with the marks found among the windows that were sent."""
    met = io.in_batches(sent.repartition("bucket").sortWithinPartitions("bucket"), _meet(last), _FOUND)
    marks = met.groupBy("doc_id", "tag").agg(F.collect_list("blob").alias("marks"))
    return docs.join(marks, ["doc_id", "tag"], "left")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, tag, text, marks: starts (uint32 blobs) of windows that start earlier elsewhere too."""
    if length < 2:
        raise ValueError("a window needs two words at least")
    n = io.buckets(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "hash(text) tag", "text")
    half = _marked(docs, io.in_batches(docs, _send_halves(length, n), _SENT), last=False)
    return _marked(docs, io.in_batches(half, _send_full(length, n), _SENT), last=True)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one blank), removed
    (word spans [from, to), end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, marks in zip(batch.column(2), batch.column(3), strict=True):
                ws = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(ws) + 1, dtype=np.int64)
                for blob in marks.as_py() or ():
                    at = np.frombuffer(blob, dtype=np.uint32).astype(np.int64)
                    at = at[at + length <= len(ws)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + length, -1)
                cover = np.cumsum(gone)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
                kept = ws if not cover.any() else [ws[i] for i in np.flatnonzero(~cover)]
                for column, value in zip(out, (len(ws), int(cover.sum()), b" ".join(kept).decode("utf-8", "surrogatepass"), edges.reshape(-1, 2).tolist()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.list_(pa.int32())))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    return io.in_batches(repeated(docs, length).select("doc_id", "tag", "text", "marks"), run, "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<int>>")


def longest_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, longest: the greatest length * 2**k of a window of that document's that occurs
    elsewhere too (in another document or at another place); documents without any are absent.

    Each level is a table of windows (document, tag, position, class); windows of one class are
    equal. A window of the next level joins two classes, and stays if its class has others.
    """
    n = docs.selectExpr("cast(doc_id as long) doc_id", "hash(text) tag", "text").where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws = (text or "").encode("utf-8", "surrogatepass").split()
                places = np.arange(max(0, len(ws) - length + 1))
                same = _digests(ws, places, length).tobytes()
                for lo in range(0, len(places), 1 << 16):
                    some = places[lo : lo + (1 << 16)]
                    k = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, doc)), pa.array(np.full(k, tag, np.int32)), pa.array(some), pa.array([same[16 * i : 16 * i + 16] for i in some.tolist()], pa.binary())], names=["doc_id", "tag", "pos", "same"])

    level = io.in_batches(n, run, "doc_id long, tag int, pos long, same binary").distinct()
    out, size = None, length
    while True:
        # a class that has several windows keeps them; the counts meet map-side first
        several = level.groupBy("same").agg(F.count("*").alias("_n")).where("_n > 1").select("same")
        level = io.written(level.join(several, "same", "left_semi"), "repeat-level")
        if level.isEmpty():
            break
        found = level.select("doc_id").distinct().withColumn("longest", F.lit(size))
        out = found if out is None else out.union(found)
        then = level.select("doc_id", "tag", (F.col("pos") - size).alias("pos"), F.col("same").alias("_next"))
        level = level.join(then, ["doc_id", "tag", "pos"]).select("doc_id", "tag", "pos", F.unhex(F.sha2(F.concat("same", "_next"), 256)).alias("same"))
        size *= 2
    if out is None:
        return level.select("doc_id", F.lit(length).alias("longest"))
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))
