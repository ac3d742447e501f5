import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import parity_join as pj
from corpusloom.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_query_is_the_contract(spark):
    got = {r[0]: tuple(r)[1:] for r in q.op6_parity_join(spark, SF).collect()}
    assert got == brute.op6(brute.rows(f"{SF}/documents.parquet", "doc_id", "text"))


def _varied(rng, n, size, edits):
    """Texts in families: edits of a base, and edits of these."""
    out = []
    for f in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(12):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(edits + 1)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
            if rng.random() < 0.2:
                words = words[: max(1, int(len(words) * 0.95))]
    return out


@pytest.mark.parametrize(("size", "edits"), [(8, 1), (14, 1), (30, 1), (60, 3), (150, 5), (700, 12)])
def test_components_are_brute_force(spark, size, edits):
    rng = random.Random(size)
    docs = list(enumerate(_varied(rng, 12, size, edits)))
    got = {r[0]: tuple(r)[1:] for r in pj.similarity_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.op6(docs)


def _hashes(rng, n):
    return [rng.getrandbits(64) for _ in range(n)]


@pytest.mark.parametrize("rule", [pj.CONTRACT, pj.Rule(5, 80, 100)])
def test_linked_sets_share_a_range(rule):
    """The pigeonhole bound itself, for pairs at the threshold."""
    rng = random.Random(5)
    for size in (6, 7, 11, 12, 20, 33, 50, 100, 400, 3000):
        for _ in range(60 if size < 400 else 8):
            common = _hashes(rng, size)
            room = size * (rule.whole - rule.least) // rule.least
            a = rng.randrange(room + 1)
            x = [*common, *_hashes(rng, a)]
            y = [*common, *_hashes(rng, room - a)]
            assert pj.linked(size, len(x), len(y), rule)
            sets = [np.array(sorted(s), dtype=np.uint64) for s in (x, y)]
            owner, keys = pj.range_keys(np.concatenate(sets), np.array([0, len(x), len(x) + len(y)]), rule)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()) or set(x) == set(y)


def test_another_rule_is_brute_force(spark):
    rng = random.Random(31)
    docs = list(enumerate(_varied(rng, 10, 40, 3) + _varied(rng, 6, 7, 1)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in pj.similarity_components(df, pj.Rule(5, 80, 100)).collect()}
    assert got == brute.op6(docs, 5, 80) != brute.op6(docs)
    with pytest.raises(ValueError, match="similarity"):
        pj.Rule(5, 0, 100)


def test_colliding_range_keys_are_verified(spark, monkeypatch):
    """Keys that say nothing only cost comparisons: links come from the texts."""
    rng = random.Random(12)
    monkeypatch.setattr(pj, "HOT", 3)
    docs = list(enumerate(_varied(rng, 5, 40, 3)))
    narrow = pj.range_keys
    monkeypatch.setattr(pj, "range_keys", lambda *x: (lambda sets, keys: (sets, keys & np.uint64(6)))(*narrow(*x)))
    got = {r[0]: tuple(r)[1:] for r in pj.similarity_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.op6(docs)


def test_one_doc_id_with_several_texts(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    docs = [(1, x), (2, y), (2, x), (3, y + " end"), (4, z)]
    got = sorted(tuple(r) for r in pj.similarity_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, 57, 1), (2, 57, 1), (2, 57, 1), (3, 58, 1), (4, 57, 4)]


def test_bit_sketch_bounds_the_difference():
    rng = random.Random(6)
    for size in (3, 100, 300, 5000):
        x = _hashes(rng, size)
        y = [*x[: size * 5 // 6], *_hashes(rng, size // 2)]
        a, b = (pj.bit_sketch(np.array(sorted(s), dtype=np.uint64)) for s in (x, y))
        difference = len(set(x) ^ set(y))
        assert difference / 3 < pj.apart(a, b) <= difference
        assert pj.apart(a, pj.folded(b, 64)) <= pj.apart(a, b)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (200, 200)]
    got = dict(pj.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_blocks_of_a_large_group(spark, monkeypatch):
    rng = random.Random(9)
    docs = list(enumerate(_varied(rng, 6, 40, 3)))
    monkeypatch.setattr(pj, "BLOCK", 3)
    got = {r[0]: tuple(r)[1:] for r in pj.similarity_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.op6(docs)


def test_odd_rows(odd, none):
    rows = pj.similarity_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: tuple(r)[1:] for r in rows}
    assert by[1][1] == by[2][1] == 1 and by[8] == (1, 8)
    assert by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (1, 6)
    assert by[None][1] is None and by[None][0] > 0
    assert pj.similarity_components(none).count() == 0


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_keys_are_told_as_sets_of_documents(step):
    """However many keys some documents share, what they meet in are equal sets; keys that a batch has
    told of very many documents, and those of more than MOST, stay rows."""
    members = {1: [5, 7], 3: [5, 7], 5: [9], 7: [5, 6, 7, 8], 9: [1, 2, 3, 4, 5, 6, 7, 8, 9], 11: [2, 3], 13: [5, 7], 15: [4, 5, 6, 7, 8]}
    rows = [(k, d, None, pj._TOLD if k == 11 and d == 2 else None) for k, docs in members.items() for d in docs]
    table = pa.table(list(zip(*rows, strict=True)), schema=pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("center", pa.int64()), ("blob", pa.binary())]))
    got = [r for batch in pj._meet(iter(table.to_batches(max_chunksize=step)), 4) for r in batch.to_pylist()]
    assert sorted(r["docs"] for r in got if r["kind"] == 4) == [[5, 6, 7, 8], [5, 7], [5, 7], [5, 7]]
    assert {r["kind"] for r in got} == {1, 4}
    assert sorted((r["key"], r["doc_id"], r["center"]) for r in got if r["kind"] == 1) == sorted((k, d, members[k][0]) for k in (9, 11, 15) for d in members[k])


@pytest.mark.parametrize(("hot", "most"), [(2, 512), (3, 2), (32, 3)])
def test_sets_and_rows_of_keys_together(spark, monkeypatch, hot, most):
    """Texts that a batch tells as rows, sets of documents and long keys are linked alike."""
    monkeypatch.setattr(pj, "HOT", hot)
    monkeypatch.setattr(pj, "MOST", most)
    rng = random.Random(41)
    docs = list(enumerate(_varied(rng, 12, 60, 3) + _varied(rng, 6, 14, 1)))
    rng.shuffle(docs)
    got = {r[0]: tuple(r)[1:] for r in pj.similarity_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.op6(docs)
