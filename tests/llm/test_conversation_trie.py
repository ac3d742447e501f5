import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn int, role string, text string, key string, label string, depth int, size int, shard string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    said = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said[conv].append((turn if turn is not None else -1, role or "", text or ""))
    order = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: (y[0], _label(y[1], y[2])))] for c, x in said.items()}
    paths = {}
    for c, own in order.items():
        h = zlib.crc32(str(c).encode()) % 6
        leader = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        paths[c] = order.get(leader, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(x[: len(m)] == m and len(x) == len(m) + 1 for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def _label(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def _rows(seed, convs):
    rng = random.Random(seed)
    out = []
    for c in convs:
        for turn in range(rng.choice([1, 2, 2, 5, 9])):
            text = rng.choice([None, "", "a", "bé", "ccc", "x" * 50, str(rng.randrange(10**6))])
            out.append((c, rng.choice([turn, turn, turn, 0, None]), rng.choice(["user", "user", None, "tool"]), text, "x", "y", 1, 2, "z"))
    return out


@pytest.mark.parametrize("shard, convs", [(1 << 14, range(60)), (20, [*range(95, 130), *range(300, 330), 100, -150, -101]), (1, range(40)), (5, [7] * 3 + [*range(200, 260, 3)])])
def test_nodes_are_brute_force(spark, shard, convs, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 3)
    rows = [*_rows(shard, convs), (None, 0, "user", "nobody", "x", "y", 1, 2, "z")]
    found = ct.node_table(spark.createDataFrame(rows, SCHEMA), shard)
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in found.collect()) == brute(rows)


def test_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 7)
    rows = [(c, t, "user", f"turn {t}", "x", "y", 1, 2, "z") for c in range(0, 4000, 100) for t in range(3)]
    rows += [(5000, t, "user", f"long {t}", "x", "y", 1, 2, "z") for t in range(150)]
    found = ct.node_table(spark.createDataFrame(rows, SCHEMA), 25)
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in found.collect()) == brute(rows)


def test_no_rows(spark):
    assert ct.node_table(spark.createDataFrame(_rows(1, [1]), SCHEMA).limit(0)).count() == 0


def test_bits_are_louds_and_children_are_found():
    key = lambda i: bytes([i]) * 16
    above = [200, 200, 1, 1, 1, 4, 6]
    table = pa.table({"key": [key(i) for i in range(1, 8)], "parent": [key(i) for i in above], "depth": [0, 0, 1, 1, 1, 2, 3], "chars": [1] * 7, "conv_id": list(range(7)), "n_convs": [2] * 7})
    order = np.random.default_rng(1).permutation(7)
    trie = ct.Trie.of(table.take(pa.array(order)))
    # level order 1 2 | 3 4 5 | 6 | 7: two tops, 3 children of 1, none of 2 and 3, one of 4, none of 5, one of 6
    assert "".join(map(str, trie.bits)) == "110" + "1110" + "0" + "0" + "10" + "0" + "10" + "0"
    row = dict(zip([c.split()[0] for c in ct.TRIES.split(", ")], trie.row(), strict=True))
    again = ct.Trie.from_row(row)
    assert list(again.parent) == [0, 0, 1, 1, 1, 4, 6] and again.levels() == [(1, 3), (3, 6), (6, 7), (7, 8)]
    at = 0
    for i in (1, 4, 6, 7):
        at = again.child(at, key(i))
    assert at == 7 and again.child(1, key(9)) is None and again.child(2, key(1)) is None
    assert [int(x) for x in again.subtree_sums(again.children[1:] == 0)[0]] == [4, 3, 1, 1, 1, 1, 1, 1]
