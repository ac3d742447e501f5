"""Queries on the ingest path, edits and views, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as qu
from ..operators import bm25, chunking, dense, fusion, ingest, retrieval, store
from ..session import spread, table, work_folder
from ..sources import markup
from .search import _ITEMS, _bm25, _items, _top


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _pieces(spark, d, size=1000):
    rows = chunking.windows(_docs(spark, d).select("doc_id", "text"), ["doc_id"], "text", size, 0, "order")
    return rows.select("doc_id", "order", F.col("piece").alias("text"))


def chunk_edits(spark, d):
    """Every fifth piece is deleted, every seventh upper-cased, every third cut in two."""
    rows = _pieces(spark, d)
    o = F.col("order") + F.col("doc_id")
    none = F.array().cast("array<string>")
    edits = rows.select("doc_id", "order", F.when(o % 5 == 0, none).when(o % 7 == 0, F.array(F.concat(F.lit("#"), "text"))).when(o % 3 == 0, F.array(F.substring("text", 1, 10), F.substring(F.col("text"), F.lit(11), F.length("text")))).alias("texts")).where("texts is not null")
    return ingest.edited(rows, edits).select("doc_id", F.col("order").cast("long").alias("order"), F.sha1("text").alias("text_sha1"))


def chunk_listing(spark, d):
    rows = _pieces(spark, d).withColumn("chunk_id", F.sha1("text"))
    return ingest.listing(rows, n=3).select("doc_id", F.col("order").cast("long").alias("order"), "chunk_id")


def move_documents(spark, d):
    rows = _docs(spark, d).select("doc_id", F.col("source").alias("folder"))
    return ingest.moved(rows, rows.where(F.col("doc_id") % 4 == 0).select("doc_id", F.lit("moved").alias("folder")))


def new_messages(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise("").alias("content"))
    return ingest.new_messages(rows).select("conv_id", "turn", F.sha1("content").alias("content_sha1"))


def summary_upsert(spark, d):
    """A summary of each source takes the place of its old one."""
    old = _docs(spark, d).groupBy("source").agg(F.min_by("text", "doc_id").alias("text")).select(F.col("source").alias("doc_id"), "text", F.lit("child").alias("chunk_level"))
    new = ingest.summaries(old.where(F.col("doc_id").isin("src1", "src2")).withColumn("text", F.lit("summary")))
    return store.upsert(ingest.summaries(old), new, ["doc_id"]).select("doc_id", F.sha1("text").alias("text_sha1"), "chunk_level")


def mask_items(spark, d):
    words = lambda n: F.transform(F.slice(F.split("text", " "), 1, n), lambda w, i: F.struct(i.cast("long").alias("id"), w.alias("value")))
    rows = lambda n, tag: _docs(spark, d).select("doc_id", F.explode(words(n)).alias("x"), F.lit(tag).alias("origin")).select("doc_id", "x.id", "x.value", "origin")
    return ingest.mask_items(rows(2, "scan"), rows(4, "manual"))


def public_hits(spark, d):
    hits = retrieval.beside(bm25.search(_docs(spark, d), _items(spark, d), 5), _docs(spark, d).select("doc_id", "text"), _items(spark, d), 5)
    return ingest.public_hits(hits).select("query_id", "doc_id", "rank", "score", F.sha1("text").alias("text_sha1"))


def trace_projection(spark, d):
    hits = retrieval.beside(bm25.search(_docs(spark, d), _items(spark, d), 20), _docs(spark, d).select("doc_id", "text"), _items(spark, d), 20)
    return retrieval.trace(hits).select("query_id", F.posexplode("trace").alias("pos", "t")).select("query_id", F.col("pos").cast("long").alias("pos"), "t.doc_id", "t.score", F.sha1("t.text").alias("text_sha1"))


def group_stats(spark, d):
    lists = bm25.search(_docs(spark, d), _items(spark, d), 20).withColumn("group_id", F.floor(F.col("query_id") / 5).cast("long"))
    return ingest.group_stats(lists, "group_id", "query_id")


def orchestrate(spark, d):
    """Benchmark lines as questions of a group each; groups by turns fused and apart."""
    groups = table(spark, d, "benchmark").select(F.col("item_id").alias("group_id"), F.when(F.col("item_id") % 2 == 0, "fuse").otherwise("separate").alias("merge_mode"), F.concat(F.split("text", "\n"), F.array(F.lit("  "))).alias("queries"), F.lit(8).alias("top_k"))
    return retrieval.orchestrate(groups, _docs(spark, d), 5).select("group_id", "rank", "doc_id", "score", F.sha1("from_query").alias("from_sha1"))


def reranker_comparison(spark, d):
    """BM25 with and without the second idf, as two scorers of the same pairs."""
    a, b = (bm25.scores(_docs(spark, d), _items(spark, d), classic=c).select(F.concat_ws(":", "query_id", "doc_id").alias("pair"), F.round("score", 6).alias("score")) for c in (False, True))
    row = retrieval.compare_rerankers(a, b, "pair")
    return row.select(F.round("max_diff", 5).alias("max_diff"), F.round("mean_diff", 5).alias("mean_diff"), F.round("jaccard", 6).alias("jaccard"))


def rerank_scores(spark, d):
    """Scores joined by candidate; a candidate without one counts as 0."""
    hits = bm25.search(_docs(spark, d), _items(spark, d), 10)
    scored = hits.where(F.col("rank") % 3 != 0).select("query_id", "doc_id", F.round(F.col("score") / F.col("rank"), 6).alias("s"))
    joined = hits.join(scored, ["query_id", "doc_id"], "left").withColumn("text", F.lit(""))
    return retrieval.reranked(joined, lambda q, t: F.col("s"), "text", "text", 5).select("query_id", "doc_id", "rerank_score", F.col("rerank").alias("rank"))


def canonical_names(spark, d):
    """Market segments as aliases of groups; other names stay as they are."""
    from ..functions.citations import canonical

    groups = {"AUTOMOBILE": ["goods", "MACHINERY"], "BUILDING": ["houses"]}
    return table(spark, d, "customer").select("c_custkey", canonical(F.col("c_mktsegment"), groups).alias("segment"))


def question_laws(spark, d):
    """The first part name word of a list that a turn holds: longest first, then earliest."""
    laws = {"x": ["tion"], "y": ["ment", "ent"], "z": ["ung"]}
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", qu.law_name(F.coalesce("text", F.lit("")), laws).alias("name"))


def effect_levels(spark, d):
    levels = {"one": ["tion", "ment"], "two": ["ung", "the "]}
    return table(spark, d, "conversations").select("conv_id", "turn", qu.effect_level(F.coalesce("text", F.lit("")), levels).alias("level"))


def dense_filtered(spark, d):
    """Vectors of one language's documents alone are searched."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = vectors.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.search(_docs(spark, d), vectors, queries, 10, "dense", where=F.col("lang") == "en")


def arms_fused(spark, d):
    """Two word arms fused: with and without the second idf."""
    a = bm25.ranked(bm25.scores(_docs(spark, d), _items(spark, d)), 20, "query_id", "doc_id")
    b = bm25.ranked(bm25.scores(_docs(spark, d), _items(spark, d), classic=True), 20, "query_id", "doc_id")
    return fusion.rrf(a, b, "query_id", "doc_id", 10).select("query_id", "doc_id", "dense_rank", "sparse_rank", "score", "final_rank")


def ingest_documents(spark, d):
    """All documents through blocks, chunks, vectors (a stand-in model), manifest and BM25."""
    docs = _docs(spark, d).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    blocks = markup.markdown_blocks(docs).withColumn("headers", F.lit(None).cast("array<string>")).withColumn("rows", F.lit(None).cast("array<array<string>>"))
    facts = docs.select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("relpath"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.length("text").cast("long").alias("size"), F.col("source").alias("folder"), F.col("source").alias("law_name"))
    batch = ingest.ingest(blocks, facts, "m", lambda t: F.array(F.length(t).cast("float"), F.lit(1.0).cast("float")))
    path = work_folder(spark)
    index = ingest.commit(spark, batch, path)
    kept = index.store.read("manifest")
    return kept.select("relpath", "content_hash", "size", "chunk_count").crossJoin(F.broadcast(index.statistics().select("n_docs")))


def dense_pairs(spark, d):
    """Cosines in the JVM of each vector and the next."""
    rows = table(spark, d, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next"))
    return rows.join(other, "vec_id").select("vec_id", F.round(dense.cosine(F.col("embedding"), F.col("_next")), 6).alias("cosine"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_edits, chunk_listing, move_documents, new_messages, summary_upsert, mask_items, public_hits, trace_projection, group_stats, orchestrate, reranker_comparison, rerank_scores,
        canonical_names, question_laws, effect_levels, dense_filtered, arms_fused, ingest_documents, dense_pairs,
    )
}

_P = "p AS (SELECT doc_id, o, substring(text, o * 1000 + 1, 1000) t FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000) AS BIGINT))) o FROM documents))"
_CLASSIC = "plain AS (SELECT query_id, p.doc_id, sum(2.5 * qtf / (1.5 + qtf) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score FROM asked JOIN terms USING (term) JOIN post p USING (term) JOIN lens l ON l.doc_id = p.doc_id, stats GROUP BY ALL)"

SQL = {
    "chunk_edits": f"""WITH {_P}, e AS (SELECT *, CASE WHEN (o + doc_id) % 5 = 0 THEN [] WHEN (o + doc_id) % 7 = 0 THEN ['#' || t] WHEN (o + doc_id) % 3 = 0 THEN [substring(t, 1, 10), substring(t, 11)] ELSE [t] END x FROM p),
      k AS (SELECT doc_id, o, CASE WHEN sum(len(x)) OVER w = 0 AND o = 0 THEN [t] ELSE x END x FROM e WINDOW w AS (PARTITION BY doc_id)), u AS (SELECT doc_id, o, unnest(x) t, unnest(range(len(x))) s FROM k)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, s) - 1 AS "order", sha1(t) text_sha1 FROM u""",
    "chunk_listing": f'WITH {_P} SELECT doc_id, o AS "order", sha1(t) chunk_id FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, sha1(t)) <= 3',
    "move_documents": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE source END folder FROM documents",
    "new_messages": "SELECT conv_id, turn, sha1(substring(text, 1, 20000)) content_sha1 FROM conversations WHERE turn % 3 <> 0 AND coalesce(text, '') <> ''",
    "summary_upsert": "SELECT source doc_id, sha1(CASE WHEN source IN ('src1', 'src2') THEN 'summary' ELSE arg_min(text, doc_id) END) text_sha1, 'document' chunk_level FROM documents GROUP BY source",
    "mask_items": "SELECT doc_id, id, value, CASE WHEN id < 2 THEN 'scan' ELSE 'manual' END origin FROM (SELECT doc_id, unnest(range(least(4, len(w)))) id, unnest(w[1:4]) AS value FROM (SELECT doc_id, string_split(text, ' ') w FROM documents))",
    "public_hits": f"WITH {_ITEMS}, {_bm25('items')}, h AS ({_top('sparse', 5)}) SELECT query_id, doc_id, rank, round(score, 4) score, sha1(substring(text, 1, 400)) text_sha1 FROM h JOIN documents USING (doc_id)",
    "trace_projection": f"WITH {_ITEMS}, {_bm25('items')}, h AS ({_top('sparse', 20)}) SELECT query_id, rank - 1 pos, doc_id, round(score, 4) score, sha1(substring(text, 1, 120)) text_sha1 FROM h JOIN documents USING (doc_id) WHERE rank <= 10",
    "group_stats": f"WITH {_ITEMS}, {_bm25('items')}, h AS ({_top('sparse', 20)}) SELECT query_id // 5 group_id, count(DISTINCT query_id) n_queries, count(doc_id) n_results, count(DISTINCT doc_id) n_distinct, CASE WHEN count(DISTINCT query_id) = 0 THEN 'empty_queries' END error FROM h GROUP BY 1",
    "orchestrate": f"""WITH q AS (SELECT item_id g, unnest(string_split(text, chr(10))) text, unnest(range(len(string_split(text, chr(10))))) o FROM benchmark), items AS (SELECT g || ':' || o query_id, text FROM q WHERE trim(text) <> ''), {_bm25('items')}, h AS ({_top('sparse', 5)}),
      l AS (SELECT g, o, h.doc_id, h.score, h.rank r, q.text FROM h JOIN q ON h.query_id = q.g || ':' || q.o),
      f AS (SELECT g, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) score, string_agg(text, ';' ORDER BY o) fq, min({{'o': o, 'r': r}}) a FROM l WHERE g % 2 = 0 GROUP BY g, doc_id)
      SELECT g group_id, row_number() OVER (PARTITION BY g ORDER BY score DESC, a, doc_id) AS rank, doc_id, score, sha1(fq) from_sha1 FROM f QUALIFY rank <= 8
      UNION ALL SELECT g, row_number() OVER (PARTITION BY g ORDER BY o, r), doc_id, score, sha1(text) FROM l WHERE g % 2 = 1""",
    "reranker_comparison": f"""WITH {_ITEMS}, {_bm25('items')}, {_CLASSIC}, j AS (SELECT s.query_id || ':' || s.doc_id pair, round(s.score, 6) x, round(p.score, 6) y FROM sparse s JOIN plain p ON s.query_id = p.query_id AND s.doc_id = p.doc_id),
      a AS (SELECT list(pair) l FROM (SELECT pair FROM j ORDER BY x DESC, pair LIMIT 5)), b AS (SELECT list(pair) l FROM (SELECT pair FROM j ORDER BY y DESC, pair LIMIT 5))
      SELECT round(max(abs(x - y)), 5) max_diff, round(avg(abs(x - y)), 5) mean_diff, round(any_value(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))), 6) jaccard FROM j, a, b""",
    "rerank_scores": f"WITH {_ITEMS}, {_bm25('items')}, h AS ({_top('sparse', 10)}), r AS (SELECT query_id, doc_id, rank r, CASE WHEN rank % 3 <> 0 THEN round(score / rank, 6) ELSE 0 END rerank_score FROM h) SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, r) AS rank FROM r QUALIFY rank <= 5",
    "canonical_names": "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'goods' WHEN 'MACHINERY' THEN 'goods' WHEN 'BUILDING' THEN 'houses' ELSE c_mktsegment END segment FROM customer",
    "question_laws": """WITH n AS (SELECT * FROM (VALUES ('tion', 'tion'), ('ment', 'ment'), ('ent', 'ment'), ('ung', 'ung'), ('x', 'tion'), ('y', 'ment'), ('z', 'ung')) t(alias, name)),
      h AS (SELECT conv_id, turn, name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(alias) DESC, instr(text, alias), name) r FROM conversations, n WHERE instr(text, alias) > 0)
      SELECT c.conv_id, c.turn, h.name FROM conversations c LEFT JOIN h ON h.conv_id = c.conv_id AND h.turn = c.turn AND r = 1""",
    "effect_levels": "SELECT conv_id, turn, CASE WHEN contains(text, 'tion') OR contains(text, 'ment') THEN 'one' WHEN contains(text, 'ung') OR contains(text, 'the ') THEN 'two' END AS level FROM conversations",
    "dense_filtered": f"WITH x AS (SELECT a.vec_id query_id, b.vec_id doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) score FROM embeddings a, embeddings b JOIN documents ON doc_id = b.vec_id WHERE a.vec_id % 50 = 0 AND lang = 'en') {_top('x', 10)}",
    "arms_fused": f"""WITH {_ITEMS}, {_bm25('items')}, {_CLASSIC}, d AS ({_top('sparse', 20)}), s AS ({_top('plain', 20)}),
      f AS (SELECT coalesce(d.query_id, s.query_id) query_id, coalesce(d.doc_id, s.doc_id) doc_id, d.rank dense_rank, s.rank sparse_rank, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 6) score FROM d FULL JOIN s ON d.query_id = s.query_id AND d.doc_id = s.doc_id)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) final_rank FROM f QUALIFY final_rank <= 10""",
    "dense_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
