"""Search queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, dense, fusion, retrieval
from ..operators.filters import compile_filter
from ..session import spread, table

#: Searches take every EVERY-th row of a table as questions, against all rows.
EVERY = 50


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as questions; each has the vector of the same number."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "query_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# -- SQL pieces --------------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]+"
_POSTINGS = f"""
toks AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '{W}') t FROM documents),
lens AS (SELECT doc_id, len(t) dl FROM toks),
post AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest(t) term FROM toks) GROUP BY ALL),
stats AS (SELECT count(*) n, avg(dl) avgdl FROM lens),
terms AS (SELECT term, count(*) df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) idf FROM post, stats GROUP BY term)"""


def _bm25(questions: str, of: str = "documents") -> str:
    """CTEs up to sparse(query_id, doc_id, score) for questions(query_id, text)."""
    return _POSTINGS.replace("FROM documents", f"FROM {of}") + f""",
asked AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{W}')) term FROM {questions}) GROUP BY ALL),
sparse AS (SELECT query_id, p.doc_id, sum(idf * 2.5 * qtf / (1.5 + qtf) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score
  FROM asked JOIN terms USING (term) JOIN post p USING (term) JOIN lens l ON l.doc_id = p.doc_id, stats GROUP BY ALL)"""


def _top(source: str, k: int, key: str = "doc_id", query: str = "query_id") -> str:
    return f"""SELECT {query}, {key}, round(score, 6) score, row_number() OVER (PARTITION BY {query} ORDER BY round(score, 6) DESC, {key}) AS rank
  FROM {source} QUALIFY rank <= {k}"""


_ITEMS = "items AS (SELECT item_id query_id, text FROM benchmark)"
_QUESTIONS = "items AS (SELECT item_id query_id, text, embedding vector FROM benchmark JOIN embeddings ON vec_id = item_id)"
_DENSE = "dense AS (SELECT query_id, vec_id doc_id, list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]) score FROM items, embeddings)"


def _rrf(k: int, dense_from: str = "dense", sparse_from: str = "sparse", recall: int = 50) -> str:
    return f"""
d AS ({_top(dense_from, recall)}), s AS ({_top(sparse_from, recall)}),
f AS (SELECT coalesce(d.query_id, s.query_id) query_id, coalesce(d.doc_id, s.doc_id) doc_id, d.rank dense_rank, s.rank sparse_rank,
  round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 6) score
  FROM d FULL JOIN s ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) final_rank FROM f QUALIFY final_rank <= {k})"""


# -- queries -----------------------------------------------------------------------------------


def tokenize_counts(spark, d):
    return bm25.tokenised(_docs(spark, d), "doc_id", "text").select("doc_id", F.col("dl").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_terms"))


def bm25_fit(spark, d):
    return bm25.fit(_docs(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_stats(spark, d):
    return bm25.statistics(_docs(spark, d), "doc_id", "text").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_doc_weights(spark, d):
    w = bm25.weights(bm25.fit(_docs(spark, d))).select("doc_id", "term", F.col("weight").alias("score"))
    return bm25.ranked(w, 5, "doc_id", "term")


def bm25_search(spark, d):
    return bm25.search(_docs(spark, d), _items(spark, d), 50)


def token_diagnostics(spark, d):
    items = _items(spark, d)
    return bm25.diagnostics(bm25.fit(_docs(spark, d), wanted=bm25.query_terms(items, "query_id", "text")), items, "query_id", "text")


def bm25_okapi(spark, d):
    return bm25.okapi(_docs(spark, d), _items(spark, d), 10)


def _vector_questions(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def dense_topk(spark, d):
    return dense.search(_vectors(spark, d), _vector_questions(spark, d), 10, "doc_id", "vector")


def inner_product_topk(spark, d):
    return dense.search(_vectors(spark, d), _vector_questions(spark, d), 10, "doc_id", "vector", normalise=False)


def dense_coarse(spark, d):
    """Vector search by 8-bit vectors, scored exactly: its rows may differ from dense_topk's."""
    return dense.search(_vectors(spark, d), _vector_questions(spark, d), 10, "doc_id", "vector", coarse="int8")


def hybrid_search(spark, d):
    return retrieval.hybrid(_docs(spark, d), _vectors(spark, d), _questions(spark, d), 10)


def filtered_hybrid(spark, d):
    only = compile_filter({"must": [{"key": "lang", "match": {"value": "en"}}], "should": [{"key": "source", "match": {"any": ["src1", "src2", "src3", "src4"]}}, {"is_empty": {"key": "source"}}]})
    return retrieval.hybrid(_docs(spark, d), _vectors(spark, d), _questions(spark, d), 10, where=only)


def hybrid_ties(spark, d):
    """Ranks of the two arms that give equal fused scores, in their order."""
    one = dense.search(_vectors(spark, d), _questions(spark, d).select("query_id", "vector"), 5, "doc_id", "vector")
    shifted = one.select("query_id", (F.col("doc_id") + 100_000_000).alias("doc_id"), "rank")
    return fusion.rrf(one, shifted, "query_id", "doc_id", 10)


def _groups(found: DataFrame) -> DataFrame:
    """Lists of the questions, five questions a group."""
    return found.withColumn("group_id", F.floor(F.col("query_id") / 5).cast("long"))


def rrf_fuse_multi(spark, d):
    lists = _groups(bm25.search(_docs(spark, d), _items(spark, d), 20))
    return fusion.fuse(lists, "group_id", "query_id", "query_id", "doc_id", 8)


def search_separate(spark, d):
    lists = _groups(bm25.search(_docs(spark, d), _items(spark, d), 5))
    return fusion.separate(lists, "group_id", "query_id").select("group_id", "position", "query_id", "doc_id", "score")


def search_multi_sum(spark, d):
    lists = _groups(bm25.search(_docs(spark, d), _items(spark, d), 20))
    return fusion.summed(lists, "group_id", "doc_id", 10)


def hierarchical_search(spark, d):
    docs = _docs(spark, d).where(F.col("text").isNotNull())
    # a source's summary is the text of its least document
    summaries = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    return retrieval.hierarchical(summaries, docs, _items(spark, d), 3, 10, "source")


def difficulty_cut(spark, d):
    hits = bm25.search(_docs(spark, d), _items(spark, d), 50)
    marks = F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))
    limits = _items(spark, d).select("query_id", F.when((marks >= 2) | (F.length("text") > 150), 10).otherwise(8).alias("top_k"))
    return retrieval.cut(hits, limits)


def context_build(spark, d):
    hits = bm25.search(_docs(spark, d), _items(spark, d), 3)
    texts = _docs(spark, d).select("doc_id", "text", F.col("source").alias("law_name"), F.lit(None).cast("string").alias("article_no"))
    return retrieval.context(retrieval.beside(hits, texts, _items(spark, d), 3)).select("query_id", F.sha2("context", 256).alias("context_sha256"), F.length("context").cast("long").alias("n_chars"))


def rerank_cut(spark, d):
    """Candidates ordered anew by a stand-in model: the share of the question's words that a text has."""
    hits = bm25.search(_docs(spark, d), _items(spark, d), 50)
    rows = retrieval.beside(hits, _docs(spark, d).select("doc_id", "text"), _items(spark, d), 50).join(_items(spark, d).withColumnRenamed("text", "question"), "query_id")

    def share(question, text):
        q = F.array_distinct(bm25.tokens(question))
        return F.round(F.size(F.array_intersect(q, bm25.tokens(text))) / F.size(q), 6)

    return retrieval.reranked(rows, share, "question", "text", 5).select("query_id", "doc_id", "rerank_score", F.col("rerank").alias("rank"))


QUERIES = {f.__name__: f for f in (tokenize_counts, bm25_fit, bm25_stats, bm25_doc_weights, bm25_search, token_diagnostics, bm25_okapi, dense_topk, inner_product_topk, dense_coarse, hybrid_search, filtered_hybrid, hybrid_ties, rrf_fuse_multi, search_separate, search_multi_sum, hierarchical_search, difficulty_cut, context_build, rerank_cut)}

_ONLY = "(lang = 'en' AND (source IN ('src1', 'src2', 'src3', 'src4') OR source IS NULL))"


def _lists(k: int) -> str:
    return f"WITH {_ITEMS}, {_bm25('items')}, lists AS (SELECT *, query_id // 5 group_id FROM ({_top('sparse', k)}))"


SQL = {
    "tokenize_counts": f"SELECT doc_id, len(t) n_tokens, len(list_distinct(t)) n_terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W}') t FROM documents)",
    "bm25_fit": f"WITH {_POSTINGS} SELECT term, df, round(idf, 6) idf FROM terms",
    "bm25_stats": f"WITH {_POSTINGS} SELECT n n_docs, round(avgdl, 6) avgdl FROM stats",
    "bm25_doc_weights": f"WITH {_POSTINGS}, w AS (SELECT doc_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) score FROM post JOIN terms USING (term) JOIN lens USING (doc_id), stats) {_top('w', 5, 'term', 'doc_id')}",
    "bm25_search": f"WITH {_ITEMS}, {_bm25('items')} {_top('sparse', 50)}",
    "token_diagnostics": f"""WITH {_ITEMS}, {_POSTINGS},
      each AS (SELECT query_id, unnest(t) token, unnest(range(len(t))) pos FROM (SELECT query_id, regexp_extract_all(lower(text), '{W}') t FROM items)),
      f AS (SELECT query_id, token, count(*) freq FROM each GROUP BY ALL)
      SELECT query_id, pos, token, round(coalesce(idf, 0), 4) idf, idf IS NULL is_oov, round(coalesce(idf * 2.5 * freq / (1.5 + freq), 0), 4) score, freq
      FROM each JOIN f USING (query_id, token) LEFT JOIN terms ON term = token""",
    "bm25_okapi": f"""WITH {_ITEMS}, {_POSTINGS},
      raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) i FROM terms, stats), m AS (SELECT avg(i) mean FROM raw),
      w AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * mean ELSE i END i FROM raw, m),
      asked AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{W}')) term FROM items) GROUP BY ALL),
      s AS (SELECT query_id, p.doc_id, sum(qtf * i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score FROM asked JOIN w USING (term) JOIN post p USING (term) JOIN lens l ON l.doc_id = p.doc_id, stats GROUP BY ALL) {_top('s', 10)}""",
    "dense_topk": f"WITH items AS (SELECT vec_id query_id, embedding vector FROM embeddings WHERE vec_id % {EVERY} = 0), {_DENSE} {_top('dense', 10)}",
    "inner_product_topk": f"WITH items AS (SELECT vec_id query_id, embedding vector FROM embeddings WHERE vec_id % {EVERY} = 0), x AS (SELECT query_id, vec_id doc_id, list_inner_product(vector::DOUBLE[], embedding::DOUBLE[]) score FROM items, embeddings) {_top('x', 10)}",
    "hybrid_search": f"WITH {_QUESTIONS}, {_bm25('items')}, {_DENSE}, {_rrf(10)} SELECT query_id, doc_id, dense_rank, sparse_rank, score, final_rank FROM fused",
    "filtered_hybrid": f"WITH {_QUESTIONS}, docs AS (SELECT * FROM documents WHERE {_ONLY}), {_bm25("items", "docs")}, {_DENSE}, near AS (SELECT * FROM dense WHERE doc_id IN (SELECT doc_id FROM docs)), {_rrf(10, 'near')} SELECT query_id, doc_id, dense_rank, sparse_rank, score, final_rank FROM fused",
    "hybrid_ties": f"""WITH {_QUESTIONS}, {_DENSE}, a AS ({_top('dense', 5)}), f AS (SELECT query_id, doc_id, rank dense_rank, NULL::BIGINT sparse_rank, round(1.0::DOUBLE / (60 + rank), 6) score FROM a
      UNION ALL SELECT query_id, doc_id + 100000000, NULL, rank, round(1.0::DOUBLE / (60 + rank), 6) FROM a)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) final_rank FROM f""",
    "rrf_fuse_multi": _lists(20) + """, x AS (SELECT group_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) score, string_agg(query_id::VARCHAR, ';' ORDER BY query_id) from_query, min({'q': query_id, 'r': rank}) f FROM lists GROUP BY ALL)
      SELECT group_id, doc_id, score, from_query, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, f, doc_id) AS rank FROM x QUALIFY rank <= 8""",
    "search_separate": _lists(5) + " SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY query_id, rank) AS position, query_id, doc_id, score FROM lists",
    "search_multi_sum": _lists(20) + ", x AS (SELECT group_id, doc_id, sum(score) score FROM lists GROUP BY ALL) " + _top("x", 10, "doc_id", "group_id"),
    "hierarchical_search": f"""WITH {_ITEMS}, {_bm25('items')},
      summ AS (SELECT source, arg_min(text, doc_id) text FROM documents WHERE text IS NOT NULL GROUP BY source),
      gt AS (SELECT source, regexp_extract_all(lower(text), '{W}') t FROM summ), gl AS (SELECT source, len(t) dl FROM gt), gp AS (SELECT source, term, count(*) tf FROM (SELECT source, unnest(t) term FROM gt) GROUP BY ALL),
      gs AS (SELECT count(*) n, avg(dl) avgdl FROM gl), gi AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) idf FROM gp, gs GROUP BY term),
      g AS (SELECT query_id, source, sum(idf * 2.5 * qtf / (1.5 + qtf) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score FROM asked JOIN gi USING (term) JOIN gp USING (term) JOIN gl USING (source), gs GROUP BY ALL),
      best AS ({_top('g', 3, 'source')}), x AS (SELECT s.* FROM sparse s JOIN documents USING (doc_id) JOIN best USING (query_id, source)) {_top('x', 10)}""",
    "difficulty_cut": f"WITH {_ITEMS}, {_bm25('items')}, hits AS ({_top('sparse', 50)}), k AS (SELECT query_id, CASE WHEN length(text) - length(replace(text, '?', '')) >= 2 OR length(text) > 150 THEN 10 ELSE 8 END top_k FROM items) SELECT query_id, doc_id, score, rank FROM hits JOIN k USING (query_id) WHERE rank <= top_k",
    "context_build": f"""WITH {_ITEMS}, {_bm25('items')}, hits AS ({_top('sparse', 3)}), x AS (SELECT query_id, h.rank, '[来源：' || coalesce(source, '') || ']' || chr(10) || text t, row_number() OVER (PARTITION BY query_id, substring(text, 1, 120) ORDER BY h.rank) n FROM hits h JOIN documents USING (doc_id)),
      c AS (SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) context FROM x WHERE n = 1 GROUP BY query_id) SELECT query_id, sha256(context) context_sha256, length(context) n_chars FROM c""",
    "rerank_cut": f"""WITH {_ITEMS}, {_bm25('items')}, hits AS ({_top('sparse', 50)}), q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '{W}')) q FROM items),
      x AS (SELECT query_id, doc_id, rank r, round(len(list_intersect(q, t)) / len(q), 6) rerank_score FROM hits JOIN toks USING (doc_id) JOIN q USING (query_id) WHERE rank <= 30)
      SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, r) AS rank FROM x QUALIFY rank <= 5""",
}
