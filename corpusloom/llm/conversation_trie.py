"""Prefix tries over conversations, as succinct level-order (LOUDS) tries.

A node is a sequence of turns with which conversations begin; its key is a chain of digests over
them. Texts are left behind where they are read: everything else carries 16-byte digests.

* `paths` gives every conversation's nodes, by a sorted stream that holds one row at a time;
  `weighed` pre-aggregates them, so that copies of a conversation count as one path.
* A node is heavy if more than SHARD_TURNS turns lie below it. Light nodes below heavy ones (or a
  light root) are the tops of prefix shards; whole shards are packed into `tries`, of SHARD_TURNS
  nodes about, each a LOUDS bitvector with its arrays of labels and weights in level order.
* `rolled_up` reads these again and sums each subtree by going through the levels backwards.
* The heavy upper levels are merged on their own (`_upper`): a shard's totals belong to every heavy
  node above it. Each shard and heavy node is credited to the conversation that gives its name, the
  smallest of its members, and each such conversation brings its sum to the heavy nodes on its path.
  So a node with very many shards below it gets partial sums, and no level waits for another.
* `end_digests` hashes the conversations that end at a node: ids are cut into ranges of (node, id),
  each range makes pieces of text, and only pieces meet, in order, in a stream by node.

Defined results: null roles and texts are empty; rows without conv_id are left out; turns are
ordered by turn, null first, equal ones by the digest of role and text, and repeated rows count
each; the remainder of a negative id has its sign; a conversation without turns left ends at the
root; no rows give no nodes; very long conversations cost a row a turn, and a path of turns that
nothing else shares is one shard as far as it is light; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _io as io

SHARD_TURNS = 1 << 14
HEADS, GROUP = 6, 100
KEY = 16
ROOT = hashlib.blake2b(b"", digest_size=KEY).digest()
NOWHERE = bytes(KEY)
#: Ids in one piece of text of `end_digests`.
PIECE = 1 << 14
#: Keys of 16 bytes, or rows of a few numbers, that are broadcast at most.
FEW = 100_000


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if a count shows that it has FEW rows at most."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def heads_of(conv_id: Column) -> Column:
    """How many turns of the conversation that leads its group a conversation begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, depth, label, chars, size; conversations: conv_id, size). Every conversation
    begins with the first turns of the one that leads its group of GROUP ids, as many as `heads_of`
    says, and goes on with its own after as many. size is its number of turns then."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), label.alias("label"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "label")
    turns = io.written(said.withColumn("pos", F.row_number().over(order)).drop("turn"), "trie-turns")
    leader = F.col("conv_id") - F.col("conv_id") % GROUP
    every = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", "own", leader.alias("leader"), heads_of(F.col("conv_id")).alias("h"))
    led = every.where("conv_id = leader").select("leader", F.col("own").alias("there"))
    every = every.join(led, "leader", "left").select("conv_id", "leader", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "own")
    every = io.written(every.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-conversations")
    first = turns.where((F.col("conv_id") == leader) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("leader"), "pos", "label", "chars")
    heads = every.join(first, "leader").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "label", "chars", "size")
    rest = turns.join(every, "conv_id").where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "label", "chars", "size")
    return heads.union(rest), every.select("conv_id", "size")


def paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, chars, size: each conversation's nodes from the root on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, ROOT
        for batch in batches:
            keys, parents = [], []
            for conv, label in zip(batch.column("conv_id").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if conv != now:
                    now, key = conv, ROOT
                parents.append(key)
                key = hashlib.blake2b(key + label, digest_size=KEY).digest()
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column("chars"), batch.column("size")], names=["conv_id", "depth", "key", "parent", "chars", "size"])

    sorted_ = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    chained = io.in_batches(sorted_.select("conv_id", "depth", "label", "chars", "size"), run, "conv_id long, depth int, key binary, parent binary, chars long, size int")
    roots = conversations.select("conv_id", F.lit(0).alias("depth"), F.lit(ROOT).alias("key"), F.lit(NOWHERE).alias("parent"), F.lit(0).cast("long").alias("chars"), F.col("size").cast("int"))
    return chained.union(roots)


def weighed(rows: DataFrame) -> DataFrame:
    """The distinct nodes of `paths`: key, parent, depth, chars, the smallest member's conv_id,
    n_convs, and `below`, the members' turns beyond it (at least as many as nodes below it)."""
    below = F.sum((F.col("size") - F.col("depth")).cast("long")).alias("below")
    one = [F.any_value(c).alias(c) for c in ("parent", "depth", "chars")]
    return rows.groupBy("key").agg(*one, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), below)


@dataclass
class Trie:
    """A forest in level order. Node 0 is above its tops; bits hold 1 for each child and a 0 for
    each node; the arrays hold a value for each node but 0."""

    bits: np.ndarray
    labels: np.ndarray
    parents: np.ndarray
    depth: np.ndarray
    chars: np.ndarray
    conv_id: np.ndarray
    n_convs: np.ndarray

    @cached_property
    def children(self) -> np.ndarray:
        """The number of each node's children: ones between two zeros."""
        return np.diff(np.flatnonzero(self.bits == 0), prepend=-1) - 1

    @cached_property
    def parent(self) -> np.ndarray:
        """The parent of nodes 1..: the zeros before the node's own 1."""
        return np.repeat(np.arange(len(self.children)), self.children)

    @cached_property
    def first_child(self) -> np.ndarray:
        return 1 + np.concatenate(([0], np.cumsum(self.children)[:-1]))

    def levels(self) -> list[tuple[int, int]]:
        out, lo, hi = [], 1, 1 + int(self.children[0])
        while lo < hi:
            out.append((lo, hi))
            lo, hi = hi, hi + int(self.children[lo:hi].sum())
        return out

    def child(self, node: int, label: bytes) -> int | None:
        """The child of a node by its label; children stand in the order of their labels."""
        lo = int(self.first_child[node])
        hi = lo + int(self.children[node])
        at = lo + int(np.searchsorted(self.labels[lo - 1 : hi - 1], np.frombuffer(label, self.labels.dtype)[0]))
        return at if at < hi and self.labels[at - 1].tobytes() == label else None

    def subtree_sums(self, *values: np.ndarray) -> list[np.ndarray]:
        """Each array of values of nodes 1.. summed over subtrees, node 0 included, levels backwards."""
        out = [np.concatenate(([0], v)).astype(np.int64) for v in values]
        for lo, hi in reversed(self.levels()):
            for total in out:
                np.add.at(total, self.parent[lo - 1 : hi - 1], total[lo:hi])
        return out

    @classmethod
    def of(cls, table: pa.Table) -> Trie:
        """From nodes: key, parent, depth, chars, conv_id, n_convs; those whose parent isn't among
        them are tops."""
        table = table.combine_chunks()
        key, above = (table.column(c).combine_chunks() for c in ("key", "parent"))
        up = pc.fill_null(pc.index_in(above, value_set=key), -1).to_numpy().astype(np.int64)
        labels = _bytes(key)
        rank = np.empty(len(up), dtype=np.int64)
        rank[np.argsort(labels, kind="stable")] = np.arange(len(up))
        # level by level, each by its parents' places and then by label
        place = np.full(len(up), -1, dtype=np.int64)
        order, level, at = [], np.flatnonzero(up < 0), 1
        below = np.argsort(up, kind="stable")
        starts = np.searchsorted(up[below], np.arange(len(up) + 1))
        while len(level):
            above_ = np.where(up[level] < 0, 0, place[up[level]])
            level = level[np.lexsort((rank[level], above_))]
            place[level] = np.arange(at, at + len(level))
            order.append(level)
            at += len(level)
            lo, hi = starts[level], starts[level + 1]
            level = below[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(int((hi - lo).sum()))]
        nodes = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        counts = np.bincount(np.where(up[nodes] < 0, 0, place[up[nodes]]), minlength=len(nodes) + 1)
        bits = np.ones(2 * len(nodes) + 1, dtype=np.uint8)
        bits[np.cumsum(counts + 1) - 1] = 0
        number = [table.column(c).to_numpy()[nodes] for c in ("depth", "chars", "conv_id", "n_convs")]
        return cls(bits, labels[nodes], _bytes(above)[nodes], *number)

    def row(self) -> list[Any]:
        n = len(self.labels)
        kinds = (self.labels, self.parents, self.depth.astype("<i4"), self.chars.astype("<i8"), self.conv_id.astype("<i8"), self.n_convs.astype("<i8"))
        return [n, np.packbits(self.bits).tobytes(), *(a.tobytes() for a in kinds)]

    @classmethod
    def from_row(cls, row: dict[str, Any]) -> Trie:
        n = row["nodes"]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=2 * n + 1)
        kinds = {"labels": _KEY_DTYPE, "parents": _KEY_DTYPE, "depth": "<i4", "chars": "<i8", "conv_id": "<i8", "n_convs": "<i8"}
        return cls(bits, *(np.frombuffer(row[c], t) for c, t in kinds.items()))


#: Keys as numbers that compare as their bytes do.
_KEY_DTYPE = np.dtype([("high", ">u8"), ("low", ">u8")])


def _bytes(column: pa.Array) -> np.ndarray:
    """Keys of KEY bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), _KEY_DTYPE)


TRIES = "nodes long, bits binary, labels binary, parents binary, depth binary, chars binary, conv_id binary, n_convs binary"


def tries(light: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """TRIES of light nodes (`weighed`, and `shard`: the key of their shard's top), whole shards together."""
    columns = ["key", "parent", "depth", "chars", "conv_id", "n_convs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def built() -> pa.RecordBatch:
            trie = Trie.of(pa.Table.from_batches(held).select(columns))
            held.clear()
            kinds = [pa.int64(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(trie.row(), kinds, strict=True)], names=[c.split()[0] for c in TRIES.split(", ")])

        for batch in batches:
            shard = batch.column("shard").to_pylist()
            heads = {i for i, (a, b) in enumerate(zip([last, *shard], shard, strict=False)) if a != b}
            cuts = sorted({0, *heads, len(shard)})
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if size >= shard_turns and lo in heads:
                    yield built()
                    size = 0
                held.append(batch.slice(lo, hi - lo))
                size += hi - lo
            last = shard[-1] if shard else last
        if held:
            yield built()

    met = light.select("shard", *columns).repartition("shard").sortWithinPartitions("shard")
    return io.in_batches(met, run, TRIES)


NODES = "key binary, parent binary, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def rolled_up(found: DataFrame) -> DataFrame:
    """NODES of TRIES. The parents of tops are in no trie: their conv_id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                trie = Trie.from_row(row)
                leaves, saved = trie.subtree_sums(trie.children[1:] == 0, (trie.n_convs - 1) * trie.chars)
                up = trie.parent
                above = pa.array(np.concatenate(([0], trie.conv_id))[up], mask=up == 0)
                keys = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (trie.labels, trie.parents)]
                arrays = [*keys, pa.array(up == 0), pa.array(trie.conv_id), pa.array(trie.depth.astype(np.int64)), above, pa.array(trie.n_convs), pa.array(trie.children[1:]), pa.array(leaves[1:]), pa.array(saved[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in NODES.split(", ")])

    return io.in_batches(found, run, NODES)


def _upper(heavy: DataFrame, tops: DataFrame, rows: DataFrame) -> DataFrame:
    """NODES of the heavy nodes, from their shards' tops and themselves."""
    own = heavy.select("key", "parent", "depth", "conv_id", F.lit(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    units = io.written(own.union(tops.select("key", "parent", F.col("depth").cast("int"), "conv_id", F.col("n_leaves"), F.col("saved_tokens"))), "trie-units")
    onwards = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    within = units.select("key", *[F.sum(c).over(onwards).alias(c) for c in ("leaves", "saved")]).join(_small(heavy.select("key")), "key", "left_semi")
    credit = units.groupBy("conv_id").agg(F.min("depth").alias("least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("least > 0")
    across = rows.select("conv_id", "depth", "key").join(_small(credit), "conv_id").where("depth < least").select("key", "leaves", "saved")
    sums = within.union(across).groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = units.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    found = heavy.join(sums, "key").join(children, "key")
    return found.select("key", "parent", F.lit(True).alias("top"), "conv_id", F.col("depth").cast("long"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")


def end_digests(rows: DataFrame) -> DataFrame:
    """key, ends_sha256: of the ids of the conversations that end at a node, in order, with commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        out: list[tuple[bytes, int, str]] = []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= PIECE):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(c)
            if out:
                yield made(out)
                out = []
        if ids:
            yield made([(key, ids[0], ",".join(map(str, ids)))])

    def made(out: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pair(out)
        if key is not None:
            yield pair([(key, digest.hexdigest())])

    def pair(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out])], names=["key", "ends_sha256"])

    ends = rows.where("depth = size").select("key", "conv_id")
    cut = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = io.in_batches(cut, pieces, "key binary, first long, ids string")
    return io.in_batches(parts.repartition("key").sortWithinPartitions("key", "first"), hashed, "key binary, ends_sha256 string")


def light_nodes(nodes: DataFrame, rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """The nodes that aren't heavy, with the top of their shard: the first such node on the path of
    the conversation that gives the node's name."""
    beyond = rows.select("conv_id", "depth", "key").join(heavy, "key", "left_anti")
    shard = beyond.groupBy("conv_id").agg(F.min_by("key", "depth").alias("shard"))
    return nodes.join(heavy, "key", "left_anti").join(shard, "conv_id")


def node_table(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """NODES of all rebuilt conversations, without `top`, and ends_sha256."""
    turns, every = rebuilt(conversations)
    rows = io.written(paths(turns, every), "trie-paths")
    nodes = io.written(weighed(rows), "trie-nodes")
    heavy = nodes.where(F.col("below") > shard_turns)
    heavy_keys = _small(heavy.select("key"))
    lower = io.written(rolled_up(io.written(tries(light_nodes(nodes, rows, heavy_keys), shard_turns), "tries")), "trie-lower")
    found = lower.union(_upper(heavy, lower.where("top"), rows))
    names = _small(heavy.select(F.col("key").alias("parent"), F.col("conv_id").alias("named")))
    tops = found.where("top").join(names, "parent", "left").withColumn("parent_conv_id", F.col("named")).select(found.columns)
    found = found.where("not top").union(tops).drop("top")
    none = hashlib.sha256(b"").hexdigest()
    return found.join(end_digests(rows), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
