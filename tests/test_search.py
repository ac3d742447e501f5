import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import plans
from corpusloom.operators import bm25, dense, fusion, retrieval

DOCS = [(1, "a b b c"), (2, "a a d"), (3, "c d e f g"), (4, ""), (5, None), (6, "B A")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def brute(query):
    toks = {d: (t or "").lower().split() for d, t in DOCS}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((n - c + 0.5) / (c + 0.5) + 1) for w, c in df.items()}
    out = {}
    for d, t in toks.items():
        s = sum(idf[w] * 2.5 * query.count(w) / (1.5 + query.count(w)) * idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in set(query) if w in t)
        if s:
            out[d] = round(s, 6)
    return out


def test_bm25(spark, docs, tmp_path):
    queries = spark.createDataFrame([(1, "a b"), (2, "c c zzz"), (3, ""), (4, None)], "query_id long, text string")
    got = {}
    for r in bm25.search(docs, queries, 10).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert got == {1: brute(["a", "b"]), 2: brute(["c", "c"])}
    index = bm25.fit(docs)
    index.save(f"file://{tmp_path}/i")
    again = bm25.Index.load(spark, f"file://{tmp_path}/i", "doc_id")
    assert sorted(map(tuple, again.terms.collect())) == sorted(map(tuple, index.terms.collect()))
    diag = bm25.diagnostics(index, queries, "query_id", "text").where("query_id = 2").orderBy("pos").collect()
    assert [(r.token, r.is_oov, r.freq) for r in diag] == [("c", False, 2), ("c", False, 2), ("zzz", True, 1)]


def _copies(spark, n=3000):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)]
    # many copies of few texts: ties that the key decides, far beyond k
    docs = spark.createDataFrame([(i * 7919 % n, rng.choice(texts) if i % 3 else texts[0]) for i in range(n)] + [(n, None), (n + 1, "")], "doc_id long, text string")
    asked = [(i, " ".join(rng.choices([*words, "unknown"], k=6))) for i in range(25)]
    return docs, spark.createDataFrame([*asked, (None, "w1 w2"), (99, ""), (98, None)], "query_id long, text string")


@pytest.mark.parametrize("classic", [False, True])
def test_best_of_each_task_are_the_best_of_all(spark, monkeypatch, classic):
    docs, asked = _copies(spark)
    monkeypatch.setattr(bm25, "_CELLS", 512)
    monkeypatch.setattr(bm25, "TASK_CHARS", 20_000)
    got = sorted(map(tuple, bm25.search(docs, asked, 7, classic=classic).collect()), key=str)
    plain = sorted(map(tuple, bm25.ranked(bm25.scores(docs, asked, classic=classic), 7, "query_id", "doc_id").collect()), key=str)
    assert got == plain and len(got) >= 25 * 7
    assert bm25.search(docs, asked.limit(0), 7).count() == 0 and bm25.search(docs.limit(0), asked, 7).count() == 0
    monkeypatch.setattr(bm25, "MAX_QUERY_ROWS", 10)
    assert sorted(map(tuple, bm25.search(docs, asked, 7, classic=classic).collect()), key=str) == plain


def test_scores_that_round_to_one(spark):
    """Keys decide among scores that are equal only when rounded, wherever these lie in the order."""
    import pyarrow as pa

    rows = pa.table({"q": [0] * 5, "key": [5, 4, 3, 2, 1], "score": [0.5000004, 0.5000003, 0.5000002, 0.5000001, 0.4]})
    kept, q, score = bm25._best(rows, 1)
    assert sorted(kept.column("key").to_pylist()) == [2, 3, 4, 5] and list(q) == [0] and list(score) == [0.5000004]


def test_terms_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    docs, asked = _copies(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(bm25, "TASK_CHARS", 10_000)
    assert bm25.fit(docs).postings.rdd.getNumPartitions() == -(-chars // 10_000) > 10
    monkeypatch.setattr(bm25, "TASK_PAIRS", 1_000)
    # 3,002 documents and 26 questions that ask for something
    assert bm25.scores(docs, asked).rdd.getNumPartitions() >= 3_002 * 26 // 1_000


def test_scores_within_values_of_a_column(spark):
    docs, asked = _copies(spark)
    docs = docs.withColumn("part", F.when(F.col("doc_id") % 4 != 3, F.col("doc_id") % 4))
    within = spark.createDataFrame([(i, i % 4) for i in range(25)] + [(1, 0), (1, 0), (2, None)], "query_id long, part long")
    whole = bm25.scores(docs, asked).join(docs.select("doc_id", "part"), "doc_id").join(within, ["query_id", "part"], "left_semi")
    flat = lambda df: {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}
    got = flat(bm25.scores(docs, asked, within=within))
    assert got == flat(whole) and got


@pytest.mark.parametrize("block", [2, 2048])
def test_dense(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    x[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    q = rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = {}
    for r in dense.search(rows, q, 3, "id", "v").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = dense.unit(x)
    assert got == {i: sorted(range(50), key=lambda j, i=i: (-round(float(u[i] @ u[j]), 6), j))[:3] for i in range(5)}
    assert dense.search(rows, q.limit(0), 3, "id", "v").count() == 0
    zero = rows.where("id in (7, 8)").select(dense.cosine(F.col("v"), F.array(*[F.lit(1.0)] * 4)).alias("c"), "id").collect()
    assert {r.id: r.c for r in zero}[7] == 0.0


@pytest.mark.parametrize(("coarse", "recall"), [("int8", 0.98), ("binary", 0.9)])
def test_coarse_vectors(spark, coarse, recall):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    q = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    pairs = lambda **kw: {(r.query_id, r.id) for r in dense.search(rows, q, 10, "id", "v", **kw).collect()}
    exact, near = pairs(), pairs(coarse=coarse, oversample=4 if coarse == "int8" else 30)
    assert len(near) == len(exact) and len(near & exact) / len(exact) >= recall
    with pytest.raises(ValueError, match="coarse"):
        pairs(coarse="hnsw")


def test_rrf_ties_and_relabelling(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 21, 2)], "q int, d int, rank int")
    assert [r.d for r in fusion.rrf(a, b, "q", "d", 9).orderBy("final_rank").collect()] == [10, 20, 11, 21]
    assert [r.d for r in fusion.rrf(b, a, "q", "d", 3).orderBy("final_rank").collect()] == [20, 10, 21]
    both = fusion.rrf(a, a, "q", "d", 9).orderBy("final_rank").collect()
    assert [(r.d, r.score) for r in both] == [(10, round(2 / 61, 6)), (11, round(2 / 62, 6))]


def test_fuse(spark):
    lists = spark.createDataFrame([(1, 0, "x", 5, 1), (1, 1, "y", 5, 1), (1, 1, "y", 6, 2), (1, 0, "x", 7, 2)], "g int, o int, name string, d int, rank int")
    got = fusion.fuse(lists, "g", "o", "name", "d", 2).orderBy("rank").collect()
    assert [(r.d, r.from_query) for r in got] == [(5, "x;y"), (7, "x")]
    assert [r.d for r in fusion.separate(lists, "g", "o").orderBy("position").collect()] == [5, 7, 5, 6]


def test_parent_child(spark):
    rows = spark.createDataFrame([("c1", "p1", "a b"), ("c2", "p1", "a"), ("c3", "p2", "a a a b b"), ("c4", "p3", "z")], "chunk_id string, parent_id string, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    got = retrieval.parent_child(rows, q, 5).orderBy("rank").collect()
    assert sorted(r.parent_id for r in got) == ["p1", "p2"]
    best = {r.chunk_id: r.score for r in bm25.search(rows, q, 9, key="chunk_id").collect()}
    assert got[0].score == max(best.values())


def test_context_and_trace(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, "t" * 130 + "1", "民法典", "32", 7), (1, 2, 0.4, "t" * 130 + "2", "x", None, 8), (1, 3, 0.3, "u", "x", None, 9)], "query_id long, rank int, score double, text string, law_name string, article_no string, doc_id long")
    assert retrieval.context(hits).first().context == "[来源：民法典 第32条]\n" + "t" * 130 + "1\n\n[来源：x]\nu"
    assert len(retrieval.trace(hits, 2).first().trace) == 2


def test_rerankers(spark):
    rng = random.Random(0)
    a = spark.createDataFrame([(i, rng.random()) for i in range(20)], "id int, score double")
    row = retrieval.compare_rerankers(a, a.withColumn("score", F.col("score") + 0.5), "id").first()
    assert round(row.max_diff, 9) == 0.5 and row.jaccard == 1.0


def test_a_failing_scorer_leaves_the_order(spark):
    from corpusloom.operators import retrieval

    hits = spark.createDataFrame([(1, "a", "q", "bb", 1), (1, "b", "q", "cccc", 2), (1, "c", "q", "d", 3)], "query_id long, doc_id string, query string, text string, rank int")

    def broken(questions, texts):
        raise ConnectionError("no model")

    order = lambda scorer: [r.doc_id for r in retrieval.reranked(hits, retrieval.guarded(scorer), "query", "text", 3).orderBy("rerank").collect()]
    assert order(lambda q, t: t.str.len()) == ["b", "a", "c"]
    assert order(broken) == ["a", "b", "c"]


def test_fit_of_wanted_terms(spark):
    docs, asked = _copies(spark)
    whole = bm25.fit(docs)
    terms = bm25.query_terms(asked, "query_id", "text")
    some = bm25.fit(docs, wanted=terms)
    flat = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    for what, columns in (("postings", ("doc_id", "term", "tf", "dl")), ("terms", ("term", "df", "idf"))):
        assert flat(getattr(some, what), *columns) == flat(getattr(whole, what).join(terms.select("term").distinct(), "term", "left_semi"), *columns)
    assert flat(some.stats, "n_docs", "avgdl") == flat(whole.stats, "n_docs", "avgdl")
    assert flat(bm25.diagnostics(some, asked, "query_id", "text"), "query_id", "pos", "token", "idf", "is_oov", "score", "freq") == flat(bm25.diagnostics(whole, asked, "query_id", "text"), "query_id", "pos", "token", "idf", "is_oov", "score", "freq")


def test_okapi_counts_terms_once(spark, monkeypatch):
    """The mean and the asked terms read one exchange of counts, scores count the asked terms' tokens alone."""
    docs, asked = _copies(spark)
    found = bm25.okapi(docs, asked, 7)
    got = sorted(map(tuple, found.collect()), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("explode(toks") == 2 and "LeftSemi" in plan[plan.index("functions=[partial_count(1), partial_first") :].split("explode(toks")[0]
    monkeypatch.setattr(bm25, "MAX_QUERY_ROWS", 10)
    assert sorted(map(tuple, bm25.okapi(docs, asked, 7).collect()), key=str) == got and len(got) >= 25 * 7


@pytest.mark.parametrize("form", ["search", "scores", "fit"])
def test_texts_are_dealt_and_not_their_tokens(spark, form):
    """A task deals the texts of its split; as a row for each token they took several times the memory."""
    docs, asked = _copies(spark)
    if form == "fit":
        found = bm25.fit(docs, wanted=bm25.query_terms(asked, "query_id", "text")).postings
    else:
        found = bm25.search(docs, asked, 7) if form == "search" else bm25.scores(docs, asked)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    dealt = [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    assert dealt
    for i in dealt:
        below = itertools.takewhile(lambda line: depth(line) > depth(lines[i]), lines[i + 1 :])  # noqa: B023
        assert not any("Generate" in line or "regexp_extract_all" in line for line in below)


@pytest.mark.parametrize("name", ["context_build", "rerank_cut", "public_hits", "trace_projection"])
def test_texts_beside_few_hits_stay_where_they_are(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for texts of any size
    try:
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin [doc_id" not in plan and "BroadcastHashJoin [doc_id" in plan


@pytest.mark.parametrize("name", ["hybrid_search", "rrf_fuse_multi", "search_separate", "search_multi_sum", "difficulty_cut"])
def test_query_deals_texts_to_many_tasks(spark, monkeypatch, name):
    """Beyond 200 tasks Spark sorts in memory what a task deals: that are texts, and the rows are those of few tasks."""
    few = sorted(map(tuple, plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str)
    chars = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(bm25, "TASK_CHARS", chars // 211)
    found = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    dealt = [i for i, line in enumerate(lines) if "hashpartitioning(doc_id" in line and "REPARTITION_BY_NUM" in line]
    assert dealt and all(int(lines[i].split("REPARTITION_BY_NUM")[0].split(",")[-2].strip(" )")) > 200 for i in dealt)
    for i in dealt:
        below = itertools.takewhile(lambda line: depth(line) > depth(lines[i]), lines[i + 1 :])  # noqa: B023
        assert not any("Generate" in line or "regexp_extract_all" in line for line in below)
    assert sorted(map(tuple, found.collect()), key=str) == few
