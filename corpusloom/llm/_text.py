"""Vectorised word splitting and hashing over Arrow string buffers.

Every word rule used here separates words at ASCII bytes only, so UTF-8 text can be cut
byte by byte without decoding it. Hashes depend on fixed constants: they are the same in
every process and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at a time; bounds the temporary arrays of a worker.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, for arrays of uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def _byte_class(delimiters: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(delimiters, dtype=np.uint8)] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = _byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = _byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: As ALNUM, for text whose capitals are still there.
ALNUM_ANY_CASE = _byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_LETTER = constants(256, 17)
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(max(n, SLICE_BYTES + 2), base, dtype=U64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=U64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive texts: byte spans in `data`, hashes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of parts of about `most` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        to = min(to, len(column))
        yield row, to, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray, fold: bool = False) -> Words:
    """Split texts into words; `fold` lower-cases A-Z first."""
    if fold:
        data = FOLD[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = rule[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] |= inside[1:-1][edges]
    closes[edges - 1] |= inside[1:-1][edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_LETTER[data] * power[:n], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))
    return Words(data, start, end, np.searchsorted(start, offsets), hashed)


def windows(hashed: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of the `length` words from each position on; positions without so many are absent."""
    n = len(hashed) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    for j, c in enumerate(constants(length, seed)):
        total += hashed[j : j + n] * c
    return mix(total)


def within(first: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """For each position with `length` words ahead in the array: do they belong to one text?"""
    n = n_words - length + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    crossing = np.zeros(n + 1, dtype=np.int32)
    ends = first[1:-1]
    ends = ends[(ends > 0) & (ends < n_words)]
    np.add.at(crossing, np.clip(ends - length + 1, 0, n), 1)
    np.add.at(crossing, np.clip(ends, 0, n), -1)
    return np.cumsum(crossing[:n]) == 0


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `width` consecutive values."""
    if len(values) < width:
        return values[:0]
    done, out = 1, values
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
