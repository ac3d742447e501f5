import random

import brute
import pytest

from corpusloom.llm import queries as q
from corpusloom.llm import repeat_windows as rw

SF = "/root/testdata/sf0.001"


def _sha(rows):
    return {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in rows}


def test_query_is_the_contract(spark):
    got = {r[0]: tuple(r)[1:] for r in q.op7_substring_dedup(spark, SF).collect()}
    assert got == brute.op7(brute.rows(f"{SF}/documents.parquet", "doc_id", "text"))


@pytest.mark.parametrize(("length", "letters"), [(2, 3), (4, 2), (5, 4), (20, 1), (6, 1)])
def test_random_texts(spark, length, letters):
    rng = random.Random(length * 10 + letters)
    docs = [(i, " ".join(rng.choice("abcdefgh"[:letters]) for _ in range(rng.randrange(60)))) for i in rng.sample(range(1000), 60)]
    rows = rw.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), length).collect()
    assert _sha(rows) == brute.op7(docs, length)


def test_many_batches_share_a_passage(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = rw.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert _sha(rows) == brute.op7(docs)


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """Hashes of 8 bits only cost comparisons."""
    from corpusloom.llm import _text as tx

    wide = tx.windows
    monkeypatch.setattr(tx, "windows", lambda *x: wide(*x) & rw._U64(0xFF))
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(60)))) for i in range(60)]
    rows = rw.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 6).collect()
    assert _sha(rows) == brute.op7(docs, 6)


def test_texts_of_one_doc_id_are_judged_each_by_itself(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = rw.remove_repeats(spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in rows) == [(1, 0, a), (2, 0, b), (2, 40, "")]


def test_doubling_until_nothing_is_left(spark):
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(50)]
    docs = [(1, shared), (2, [f"x{i}" for i in range(7)] + shared[:45]), (3, shared[10:31] + ["y"]), (4, [f"z{rng.random()}" for _ in range(99)]), (5, ["r"] * 30)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    got = dict(rw.longest_repeats(df, 5).collect())
    for doc, words in docs:
        size = 0
        for k in (5, 10, 20, 40, 80):
            places = [(d, i, tuple(w[i : i + k])) for d, w in docs for i in range(len(w) - k + 1)]
            own = {w for d, _, w in places if d == doc}
            if any(sum(x == w for _, _, x in places) > 1 for w in own):
                size = k
        assert got.get(doc, 0) == size
    assert rw.longest_repeats(df.where("doc_id = 4"), 5).count() == 0


def test_odd_rows(odd, none):
    rows = rw.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_words  # copies of an earlier text
    assert [r.n_removed for r in rows if r.doc_id == 2] == [by[2].n_words] * 2
    assert by[8].n_words == 30_000 and by[8].n_removed == 30_000 - 1
    assert by[None].n_removed == 0 and by[3].n_words == by[4].n_words == by[5].n_words == 0
    assert rw.remove_repeats(none).count() == 0
    with pytest.raises(ValueError, match="two words"):
        rw.repeated(odd, 1)
