import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators import chunking, ingest, retrieval
from corpusloom.operators.commit_log import Store
from corpusloom.sources import external, markup


def _blocks(docs):
    return markup.markdown_blocks(docs).withColumn("headers", F.lit(None).cast("array<string>")).withColumn("rows", F.lit(None).cast("array<array<string>>"))


def _batch(spark, rows, cache=None):
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    facts = docs.select("doc_id", F.concat("doc_id", F.lit(".md")).alias("relpath"), F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("size"), F.lit("f").alias("folder"), F.lit("law").alias("law_name"))
    return ingest.ingest(_blocks(docs), facts, "m", lambda t: F.array(F.length(t).cast("float")), cache=cache)


def test_two_commits(spark, tmp_path):
    path = f"file://{tmp_path}/kb"
    first = ingest.commit(spark, _batch(spark, [("a", "# A\nalpha beta"), ("b", "beta")]), path)
    assert first.statistics().first().n_docs == 2
    cache = Store(spark, path).read("vectors").select("content_hash", F.array(F.lit(-1.0).cast("float")).alias("vector")).dropDuplicates(["content_hash"])
    second = ingest.commit(spark, _batch(spark, [("b", "beta"), ("c", "gamma")], cache), path)
    assert second.statistics().first().n_docs == 3  # a document given again is one
    assert {r.term: r.df for r in second.terms().collect()} == {"alpha": 1, "beta": 2, "gamma": 1}
    vectors = {r.chunk_id: r.vector for r in Store(spark, path).read("vectors").collect()}
    assert len(vectors) == 3 and [-1.0] in vectors.values()  # from the cache
    chunks = Store(spark, path).read("chunks")
    assert chunks.where("chunk_level = 'parent'").count() == 3 and ingest.lookup(chunks, F.col("doc_id") == "c").count() == 1
    assert Store(spark, path).read("manifest").count() == 3
    # a document given again with less text loses the chunks it doesn't have any more
    third = ingest.commit(spark, _batch(spark, [("a", "")]), path)
    assert {r.term: r.df for r in third.terms().collect()} == {"beta": 1, "gamma": 1}
    assert Store(spark, path).read("vectors").count() == Store(spark, path).read("chunks").where("chunk_level = 'child'").count() == third.statistics().first().n_docs


def test_scratch_goes_and_chunks_at_rest_are_not_written_again(spark, tmp_path, monkeypatch):
    (tmp_path / "work").mkdir()
    monkeypatch.setattr(session, "work_folder", lambda _: f"file://{tmp_path}/work/{uuid.uuid4().hex}")
    batch = _batch(spark, [("a", "# A\nalpha beta"), ("b", "beta")])
    chunks = [x.name for x in (tmp_path / "work").iterdir()]
    assert len(chunks) == 1
    for n in (2, 3):  # the second time with rows that go
        index = ingest.commit(spark, batch, f"file://{tmp_path}/kb")
        assert [x.name for x in (tmp_path / "work").iterdir()] == chunks
        assert index.statistics().first().n_docs == 2 and Store(spark, index.store.root).read("chunks").count() == 4


def test_facts_join_documents_and_no_text_of_chunks_is_dealt(spark):
    docs = spark.createDataFrame([("a", "# A\nalpha beta\n\n" + "".join(f"句{i}。" for i in range(600))), ("b", "beta"), ("b", "gamma")], "doc_id string, text string")
    facts = spark.createDataFrame([("a", 1), ("c", 2)], "doc_id string, folder int")
    got = chunking.structural(_blocks(docs), facts=facts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    want = chunking.structural(_blocks(docs)).join(facts, "doc_id", "left")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    rows = [r for r in got.where("chunk_level = 'child'").orderBy("doc_id", "order").collect() if r.doc_id == "a"]
    ids = [r.chunk_id for r in rows]
    assert len(ids) > 2 and [r.prev_chunk_id for r in rows] == [None, *ids[:-1]] and [r.next_chunk_id for r in rows] == [*ids[1:], None]


def test_last_chunk_stays(spark):
    rows = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("e", 0, "x")], "doc_id string, order int, text string")
    edits = spark.createDataFrame([("d", 0, []), ("d", 1, []), ("e", 0, ["x1", "x2"])], "doc_id string, order int, texts array<string>")
    got = sorted((r.doc_id, r.order, r.text) for r in ingest.edited(rows, edits).collect())
    assert got == [("d", 0, "a"), ("e", 0, "x1"), ("e", 1, "x2")]


def test_messages_and_ids(spark):
    df = spark.createDataFrame([(1, "x" * 30_000), (2, ""), (3, None)], "id int, content string")
    assert [len(r.content) for r in ingest.new_messages(df).collect()] == [20_000]
    ids = spark.createDataFrame([("0" * 32,), ("0" * 31,), ("../" + "0" * 29,), (None,)], "i string")
    assert [r.v for r in ids.select(ingest.valid_id(F.col("i")).alias("v")).collect()] == [True, False, False, False]


def test_modes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(1, "c", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    assert [r.doc_id for r in retrieval.search(docs, vectors, q, 1, "dense").collect()] == [1]
    assert [r.doc_id for r in retrieval.search(docs, vectors, q, 1, "bm25").collect()] == [2]
    assert retrieval.search(docs, vectors, q, 5).count() == 2
    with pytest.raises(ValueError, match="mode"):
        retrieval.search(docs, vectors, q, 1, "parent_child")
    with pytest.raises(ValueError, match="fusion"):
        retrieval.search(docs, vectors, q, 1, fusion_name="dbsf")


def test_empty_groups(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    groups = spark.createDataFrame([(1, "fuse", ["", " "], 5), (2, "separate", ["a", "a"], 1), (3, "fuse", [], 5)], "group_id long, merge_mode string, queries array<string>, top_k int")
    assert [(r.group_id, r.rank) for r in retrieval.orchestrate(groups, docs).orderBy("rank").collect()] == [(2, 1), (2, 2)]


def _client(options):
    if options["query"] == "slow":
        raise TimeoutError
    return [(f"{options['query']}-{i}", "t", "x", "u") for i in range(2)]


def test_outside_service(spark):
    external.register(spark, "loom_cases", _client)
    rows = spark.read.format("loom_cases").option("query", "a\nslow\n").load().collect()
    assert sorted((r.query, r.case_id, r.error) for r in rows if not r.error) == [("a", "a-0", None), ("a", "a-1", None)]
    assert [(r.query, r.error) for r in rows if r.error] == [("slow", "TIMEOUT")]
    external.register(spark, "loom_none", None)
    assert spark.read.format("loom_none").option("query", "a").load().first().error == "NEED_SETUP"
