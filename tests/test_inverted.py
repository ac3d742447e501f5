import random
import uuid

import pytest

from corpusloom import session
from corpusloom.operators import bm25, inverted
from corpusloom.operators.commit_log import Store
from corpusloom.operators.inverted import SearchIndex

WORDS = ["a", "b", "c", "d", "e", "f", "g", "hapax", "ünïcode", "北京"]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _random(rng, ids):
    # word frequencies fall off, lengths differ, some texts are equal or have no words
    return [(i, rng.choice([None, "", "a a b"] + [" ".join(rng.choices(WORDS, [2.0**-j for j in range(len(WORDS))], k=rng.choice([1, 3, 8, 40]))) for _ in range(12)])) for i in ids]


def _queries(spark):
    return spark.createDataFrame([(1, "a"), (2, "g hapax a"), (3, "北京 b c d e f g a a"), (4, "nothing here"), (5, None), (6, "hapax")], "query_id long, text string")


def _rows(found):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect())


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index that has seen uploads, replacements and deletes, and the documents that are left."""
    inverted.BLOCK, inverted.SEGMENT, before = 4, 16, (inverted.BLOCK, inverted.SEGMENT)
    rng = random.Random(7)
    index = SearchIndex.create(Store.create(spark, f"file://{tmp_path_factory.mktemp('i')}/s"), buckets=4)
    left = dict(_random(rng, range(120)))
    index.update(_docs(spark, list(left.items())))
    new = dict(_random(rng, range(60, 160)))
    gone = [5, 6, 61, 400]
    index.update(_docs(spark, [r for r in new.items() if r[0] != 61]), _docs(spark, [(i, None) for i in gone]))
    left = {k: v for k, v in {**left, **new}.items() if k not in gone}
    inverted.BLOCK, inverted.SEGMENT = before
    return index, left


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search_is_that_of_all_documents(spark, grown, k):
    index, left = grown
    want = bm25.search(_docs(spark, list(left.items())), _queries(spark), k)
    assert _rows(index.search(_queries(spark), k)) == _rows(want)


def test_statistics_are_those_of_a_fresh_fit(spark, grown):
    index, left = grown
    fresh = bm25.fit(_docs(spark, list(left.items())))
    assert {(r.term, r.df, round(r.idf, 9)) for r in index.terms().collect()} == {(r.term, r.df, round(r.idf, 9)) for r in fresh.terms.collect()}
    assert tuple(index.statistics().select("n_docs", "avgdl").first()) == pytest.approx(tuple(fresh.stats.first()))


def test_only_asked_buckets_are_read(spark, grown):
    index, _ = grown
    asked = spark.createDataFrame([(6, "hapax")], "query_id long, text string")
    terms = asked.selectExpr("text term")
    found = index._asked_blocks(terms, index.store.version().number)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert found.select("bucket").distinct().count() == 1


def test_old_versions_are_searched_as_they_were(spark, grown):
    index, _ = grown
    first = next(n for n in index.store._numbers() if index.store.version(n).tables.get("bm25_docs") and index.store.version(n).tables["bm25_docs"].folders)
    rng = random.Random(7)
    assert _rows(index.search(_queries(spark), 3, number=first)) == _rows(bm25.search(_docs(spark, _random(rng, range(120))), _queries(spark), 3))


def test_compaction_changes_no_result_and_empty_indexes_have_none(spark, grown, tmp_path):
    index, left = grown
    index.compact()
    want = bm25.search(_docs(spark, list(left.items())), _queries(spark), 7)
    assert _rows(index.search(_queries(spark), 7)) == _rows(want)
    assert index._read("gone").count() == 0 and {r.part for r in index._read("blocks").select("part").distinct().collect()} == {index.store.version().number}
    none = SearchIndex.create(Store.create(spark, f"file://{tmp_path}/none"), buckets=2)
    assert none.search(_queries(spark), 3).count() == 0
    none.update(_docs(spark, []))
    assert none.search(_queries(spark), 3).count() == 0 and none.terms().count() == 0


def test_writing_deals_no_postings_and_no_task_has_a_whole_bucket(spark, grown):
    index, _ = grown
    plan = index._blocks(index._read("docs"), 9)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    plan = index._by_bucket(index._read("terms").select("term", "df"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions [bucket" in plan


def test_a_task_orders_a_segment_at_a_time(spark):
    docs = inverted.term_counts(_docs(spark, _random(random.Random(3), range(200))), "doc_id", "text").where("size(terms) > 0")
    rows = docs.select("doc_id", "dl", "terms", "tfs").toArrow().combine_chunks()
    made = [r for b in inverted._segments(9.0, 4, 50)(iter(rows.to_batches())) for r in b.to_pylist()]
    sizes = {}
    for r in made:
        sizes[r["segment"]] = sizes.get(r["segment"], 0) + r["n"]
        assert r["n"] == len(r["keys"]) <= 4 and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"])
        assert r["n"] == 4 or r["block"] == max(x["block"] for x in made if (x["term"], x["segment"]) == (r["term"], r["segment"]))
    assert len(sizes) > 5 and max(sizes.values()) < 2 * 50 + len(WORDS)
    got = sorted((k, r["term"], tf, dl) for r in made for k, tf, dl in zip(r["keys"], r["tfs"], r["dls"], strict=True))
    assert got == sorted((r.doc_id, t, tf, r.dl) for r in docs.collect() for t, tf in zip(r.terms, r.tfs, strict=True))


def test_updates_and_searches_leave_no_scratch_but_the_hits(spark, tmp_path, monkeypatch):
    (tmp_path / "work").mkdir()
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(session, "work_folder", lambda _: f"file://{tmp_path}/work/{uuid.uuid4().hex}")
    index = inverted.build(Store.create(spark, f"file://{tmp_path}/i"), _docs(spark, [(1, "a b"), (2, "b c")]), buckets=2)
    index.update(_docs(spark, [(2, "c c")]), _docs(spark, [(1, None)]))
    assert not list((tmp_path / "work").iterdir())
    assert [(r.query_id, r.doc_id) for r in index.search(spark.createDataFrame([(1, "a b c")], "query_id long, text string"), 3).collect()] == [(1, 2)]
    assert len(list((tmp_path / "work").iterdir())) == 1 and spark.conf.get("spark.sql.files.maxPartitionBytes") == split


def test_few_first_blocks_change_no_result(spark, grown, monkeypatch):
    index, left = grown
    monkeypatch.setattr(inverted, "FIRST", 1)
    assert _rows(index.search(_queries(spark), 5)) == _rows(bm25.search(_docs(spark, list(left.items())), _queries(spark), 5))


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_documents_are_scored_where_bounds_rule_out_few(spark, grown, monkeypatch, k):
    index, left = grown
    monkeypatch.setattr(inverted, "FEW", 0)
    done = []
    monkeypatch.setattr(SearchIndex, "_scanned", lambda *a, whole=SearchIndex._scanned: done.append(1) or whole(*a))
    want = bm25.search(_docs(spark, list(left.items())), _queries(spark), k)
    assert _rows(index.search(_queries(spark), k)) == _rows(want) and done
