"""Chat formatting by assembling tokens.

Every text of a conversation is encoded by itself, with a byte-level vocabulary whose file is a
parameter; the control strings of the template never pass through it but are spliced in as ids of
their own behind the vocabulary's. So no text can make a control id. Control strings that occur in
a text are escaped as well, by a backslash behind their first character (one more than stand there
already), so that the written-out text too can be read back: `escape` is reversed by `unescape`.

Texts are encoded where they are read, so that a long conversation doesn't burden one task with it;
the ids meet by conversation in a sorted stream, which holds a block of BLOCK_TOKENS and one text
at a time. Positions of segments are prefix sums of their lengths, and the loss mask is the prefix
sum of +1 where a learnt segment starts and -1 where it ends.

A conversation is one stream of its turns, since its digest is a single hash over them: one that
held a third of all rows would be read by one task, block by block.

Defined results: null roles and texts are empty; rows are ordered by turn, null first, and among
equal turns by role and ids, repeated rows count each; rows without conv_id are one conversation
whose id is null; roles that the template doesn't know keep their name in the output; texts without
characters have no ids, and a conversation of such has control ids alone; no rows give no
conversations; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io as io

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary's public tokenizer cuts text before it merges bytes.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids after which a block of a conversation ends with the turn it is in.
BLOCK_TOKENS = 1 << 16


@dataclass(frozen=True)
class Template:
    """Control strings: before a conversation, around the turns of each known role, and around the
    name and the text of others. A frame without an opening string belongs to one role at most."""

    begin: str = "<s>"
    frames: dict[str, tuple[str | None, str]] = field(default_factory=lambda: {"user": ("[INST]", "[/INST]"), "assistant": (None, "</s>"), "system": ("<<SYS>>", "<</SYS>>")})
    other: tuple[str, str, str] = ("<|role|>", "<|says|>", "<|end|>")
    learnt: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        if len(set(self.controls)) != len(self.controls) or sum(a is None for a, _ in self.frames.values()) > 1:
            raise ValueError("control strings have to differ, and one frame at most opens with none")
        for c in self.controls:
            if len(c) < 2 or "\\" in c or self.escape(c) != f"{c[0]}\\{c[1:]}":
                raise ValueError(f"control string {c!r} is too short, has a backslash or holds another one")

    @cached_property
    def controls(self) -> list[str]:
        return [self.begin, *(c for pair in self.frames.values() for c in pair if c is not None), *self.other]

    @cached_property
    def _rules(self) -> tuple[re.Pattern[str], re.Pattern[str]]:
        rests: dict[str, list[str]] = {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        ahead = [(re.escape(a), rf"(?=\\*(?:{'|'.join(b)}))") for a, b in rests.items()]
        return re.compile("|".join(f"{a}{b}" for a, b in ahead)), re.compile("|".join(rf"(?<={a})\\{b}" for a, b in ahead))

    def escape(self, text: str) -> str:
        """`text` without control strings: each gets a backslash behind its first character, as
        does each that has some there already."""
        return self._rules[0].sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._rules[1].sub("", text)


TEMPLATE = Template()


class Codec:
    """A vocabulary with the template's control strings as ids behind its own."""

    def __init__(self, vocabulary: bytes, template: Template) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.template = template
        self._text = tiktoken.Encoding("text", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.reserved = max(ranks.values()) + 1
        self.ids = {c: self.reserved + i for i, c in enumerate(template.controls)}
        self.dtype = np.dtype("<u2") if self.reserved + len(self.ids) <= 1 << 16 else np.dtype("<u4")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._text.encode_ordinary(self.template.escape(text)), dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        """The escaped text of ids that hold no control id."""
        return self._text.decode_bytes(ids.tolist()).decode("utf-8")

    def written_out(self, ids: np.ndarray) -> str:
        """The whole formatted text, control strings and escaped texts."""
        parts, at = [], 0
        for stop in [*np.flatnonzero(ids >= self.reserved), len(ids)]:
            parts.append(self.decode(ids[at:stop]))
            if stop < len(ids):
                parts.append(self.template.controls[int(ids[stop]) - self.reserved])
            at = stop + 1
        return "".join(parts)

    def segments(self, role: str, name: np.ndarray, text: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Segments of a turn and which of them is its text."""
        one = lambda c: np.array([self.ids[c]], dtype=self.dtype)
        if role in self.template.frames:
            opens, closes = self.template.frames[role]
            return [*([one(opens)] if opens else []), text, one(closes)], 1 if opens else 0
        a, b, c = self.template.other
        return [one(a), name, one(b), text, one(c)], 3

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a block, read from its ids alone."""
        controls, frames = self.template.controls, self.template.frames
        opening = {opens: (role, closes) for role, (opens, closes) in frames.items()}
        stops = np.flatnonzero(ids >= self.reserved)
        at, k = 0, 0

        def until(want: str) -> str:
            nonlocal at, k
            if k >= len(stops) or controls[int(ids[stops[k]]) - self.reserved] != want:
                raise ValueError(f"no {want} where a turn has to end")
            text = self.template.unescape(self.decode(ids[at : stops[k]]))
            at, k = int(stops[k]) + 1, k + 1
            return text

        while at < len(ids):
            first = controls[int(ids[at]) - self.reserved] if ids[at] >= self.reserved else None
            if at == 0 and first == self.template.begin:
                at, k = 1, 1
                continue
            if first == self.template.other[0]:
                at, k = at + 1, k + 1
                role = until(self.template.other[1])
                yield role, until(self.template.other[2])
                continue
            if first in opening and first is not None:
                at, k = at + 1, k + 1
            role, closes = opening[first if first in opening else None]
            yield role, until(closes)

    def learnt_text(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[str]:
        """The text of each run of ids under the mask, unescaped; control ids have none."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
        for a, b in edges.reshape(-1, 2):
            run = ids[a:b]
            yield self.template.unescape(self.decode(run[run < self.reserved]))


@lru_cache(maxsize=2)
def _codec(vocabulary: bytes, controls: tuple[Any, ...]) -> Codec:
    begin, frames, other, learnt = controls
    return Codec(vocabulary, Template(begin, dict(frames), other, learnt))


def _shared(spark: SparkSession, path: str, template: Template) -> Any:
    """A function that gives a worker its codec; the vocabulary's file, of a fixed size, is broadcast."""
    with open(path, "rb") as file:
        held = spark.sparkContext.broadcast(file.read())
    key = (template.begin, tuple(template.frames.items()), template.other, template.learnt)
    return lambda: _codec(held.value, key)


def _list(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def loss_mask(segments: list[np.ndarray], learnt: list[int]) -> np.ndarray:
    """Which ids belong to the segments of these numbers, by two prefix sums."""
    start = np.concatenate(([0], np.cumsum([len(s) for s in segments]))).astype(np.int64)
    change = np.zeros(int(start[-1]) + 1, dtype=np.int32)
    chosen = np.array(learnt, dtype=np.int64)
    np.add.at(change, start[chosen], 1)
    np.add.at(change, start[chosen + 1], -1)
    return np.cumsum(change[:-1]) > 0


BLOCKS = "conv_id long, block long, last boolean, n_turns long, ids array<int>, mask array<boolean>"


def formatted(conversations: DataFrame, vocabulary: str = VOCABULARY, template: Template = TEMPLATE, block_tokens: int = BLOCK_TOKENS, learn_stop: bool = False) -> DataFrame:
    """BLOCKS: the ids of each conversation and which of them are learnt, in one block unless it is
    longer than block_tokens; blocks end with a turn. With learn_stop the control string behind a
    learnt text is learnt too."""
    codec = _shared(conversations.sparkSession, vocabulary, template)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            conv, turn, role, text = batch.columns
            roles = role.to_pylist()
            names = [b"" if r in template.frames else own.encode(r).tobytes() for r in roles]
            ids = [own.encode(t).tobytes() for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([conv, turn, role, pa.array(names, pa.binary()), pa.array(ids, pa.binary())], names=["conv_id", "turn", "role", "name", "ids"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        out: list[tuple[int | None, int, bool, int, np.ndarray, np.ndarray]] = []
        now: tuple[int | None] | None = None
        block = turns = size = held = 0
        segments: list[np.ndarray] = []
        learnt: list[int] = []

        def close(last: bool) -> None:
            nonlocal block, turns, size, held
            ids = np.concatenate(segments).astype(np.int32)
            out.append((now[0], block, last, turns, ids, loss_mask(segments, learnt)))
            segments.clear()
            learnt.clear()
            block, turns, size, held = block + 1, 0, 0, held + len(ids)

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=False)]
            made = pa.RecordBatch.from_arrays([*arrays, _list(list(columns[4]), pa.int32()), _list(list(columns[5]), pa.bool_())], names=["conv_id", "block", "last", "n_turns", "ids", "mask"])
            out.clear()
            held = 0
            return made

        for batch in batches:
            for conv, role, name, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "name", "ids")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close(True)
                    now, block = (conv,), 0
                    segments.append(np.array([own.ids[template.begin]], dtype=own.dtype))
                elif size >= block_tokens:
                    close(False)
                own_segments, text = own.segments(role, np.frombuffer(name, own.dtype), np.frombuffer(ids, own.dtype))
                if role in template.learnt:
                    learnt += range(len(segments) + text, len(segments) + text + 1 + learn_stop)
                segments += own_segments
                turns, size = turns + 1, size + sum(map(len, own_segments))
                if held >= 1 << 19:
                    yield batch_of()
        if now is not None:
            close(True)
        if out:
            yield batch_of()

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = io.in_batches(rows, encoded, "conv_id long, turn long, role string, name binary, ids binary")
    met = ids.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "ids")
    return io.in_batches(met, assembled, BLOCKS)


def turns(blocks: DataFrame, vocabulary: str = VOCABULARY, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, block, number in it, role and text of each turn, read back from the ids."""
    codec = _shared(blocks.sparkSession, vocabulary, template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            for conv, block, ids in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = list(own.turns(ids.values.to_numpy()))
                n = len(found)
                arrays = [pa.array([conv.as_py()] * n, pa.int64()), pa.array([block.as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([r for r, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "block", "number", "role", "text"])

    return io.in_batches(blocks.select("conv_id", "block", "ids"), run, "conv_id long, block long, number long, role string, text string")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(blocks: DataFrame, vocabulary: str = VOCABULARY, template: Template = TEMPLATE) -> DataFrame:
    """DIGESTS of each conversation, read back from its blocks: of role, line break, text and line
    break of each turn, and of the learnt text. Only conversations of several blocks are brought
    together, sorted, and read block by block."""
    codec = _shared(blocks.sparkSession, vocabulary, template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        n = chars = loss_chars = 0
        said, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for conv, block, last, ids_, mask_ in zip(*(batch.column(c) for c in ("conv_id", "block", "last", "ids", "mask")), strict=True):
                if block.as_py() == 0:
                    n = chars = loss_chars = 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                ids, mask = ids_.values.to_numpy(), mask_.values.to_numpy(zero_copy_only=False)
                for role, text in own.turns(ids):
                    n += 1
                    said.update(f"{role}\n{text}\n".encode())
                for text in own.learnt_text(ids, mask):
                    loss_chars += len(text)
                    loss.update(text.encode())
                chars += len(own.written_out(ids))
                if last.as_py():
                    out.append((conv.as_py(), n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    columns = ["conv_id", "block", "last", "ids", "mask"]
    alone = blocks.where("block = 0 and last").select(columns)
    several = blocks.where("not (block = 0 and last)").select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return io.in_batches(alone, run, DIGESTS).union(io.in_batches(several, run, DIGESTS))
