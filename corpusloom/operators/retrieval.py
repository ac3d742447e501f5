"""Search strategies over batches of questions: every stage is one lazy plan."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import bm25, dense, fusion

_log = logging.getLogger(__name__)

RECALL = 50
RERANKED = 30


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, recall: int = RECALL, where: Column | None = None) -> DataFrame:
    """docs (doc_id, text, ...), vectors (doc_id, vector), queries (query_id, text, vector).

    The filter limits both arms before their top `recall`; BM25 statistics are those of all docs
    that pass it. Result: query_id, doc_id, dense_rank, sparse_rank, score, final_rank.
    """
    if where is not None:
        docs = docs.where(where)
        vectors = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
    near = dense.search(vectors, queries, recall, "doc_id", "vector")
    words = bm25.search(docs, queries, recall)
    return fusion.rrf(near, words, "query_id", "doc_id", k)


def hierarchical(summaries: DataFrame, docs: DataFrame, queries: DataFrame, k_docs: int, k: int, parent: str) -> DataFrame:
    """Best groups by their summaries (parent, text), then best documents within these groups."""
    groups = bm25.search(summaries, queries, k_docs, key=parent)
    return bm25.ranked(bm25.scores(docs, queries, within=groups.select("query_id", parent)), k, "query_id", "doc_id")


def parent_child(children: DataFrame, queries: DataFrame, k: int, child: str = "chunk_id", parent: str = "parent_id") -> DataFrame:
    """The best max(2k, 50) children of each question; a parent scores as its best child."""
    most = max(2 * k, RECALL)
    hits = bm25.search(children, queries, most, key=child)
    best = beside(hits, children.select(child, parent), queries, most, child).groupBy("query_id", parent).agg(F.max("score").alias("score"))
    return bm25.ranked(best, k, "query_id", parent)


def beside(hits: DataFrame, rows: DataFrame, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """hits, at most k of each question, with the columns of their rows. Few hits are broadcast, so that rows
    (with texts, mostly) stay where they are read; that k bounds them, they needn't be found to be counted."""
    few = k * queries.limit(1_000_001).count() <= 1_000_000
    return rows.join(F.broadcast(hits) if few else hits, key)


def cut(hits: DataFrame, limits: DataFrame, rank: str = "rank") -> DataFrame:
    """Hits up to the top_k of their question (query_id, top_k)."""
    return hits.join(broadcast_if_small(limits, 1_000_000), "query_id").where(F.col(rank) <= F.col("top_k")).drop("top_k")


def guarded(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A scorer of batches of questions and texts for `reranked`. A batch that it fails on gets no
    scores, and hits without scores stay in the order they were found in."""

    def scored(questions: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(score(questions, texts), dtype="float64")
        except Exception:  # a model of the caller's may fail in any way
            _log.exception("no scores for %d hits", len(texts))
            return pd.Series([None] * len(texts), dtype="float64")

    return F.pandas_udf(scored, "double")


def reranked(hits: DataFrame, scorer: Callable[[Column, Column], Column], query_text: str, text: str, k: int, candidates: int = RERANKED) -> DataFrame:
    """The first `candidates` of each question ordered anew by scorer(question, text) and cut; a
    missing score counts as 0. If a question has no score at all, its hits keep their order."""
    some = hits.where(F.col("rank") <= candidates).withColumn("rerank_score", F.coalesce(scorer(F.col(query_text), F.col(text)), F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return some.withColumn("rerank", F.row_number().over(w)).where(F.col("rerank") <= k)


def compare_rerankers(a: DataFrame, b: DataFrame, key: str, top: int = 5) -> DataFrame:
    """One row: largest and mean difference of scores, Jaccard of the first `top`."""
    both = a.select(key, F.col("score").alias("x")).join(b.select(key, F.col("score").alias("y")), key)
    differences = both.agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_diff"))

    def first(score: str, name: str) -> DataFrame:
        return both.orderBy(F.desc(score), key).limit(top).agg(F.collect_set(key).alias(name))

    # three tables of one row each
    out = differences.crossJoin(F.broadcast(first("x", "p"))).crossJoin(F.broadcast(first("y", "q")))
    return out.select("max_diff", "mean_diff", (F.size(F.array_intersect("p", "q")) / F.size(F.array_union("p", "q"))).alias("jaccard"))


def context(hits: DataFrame, query: str = "query_id", width: int = 120) -> DataFrame:
    """The text given to a model for each question: its hits in order, those with an equal
    beginning once, each under a line that names its source."""
    w = Window.partitionBy(query, F.substring("text", 1, width)).orderBy("rank")
    once = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    head = F.concat(F.lit("[来源："), F.coalesce("law_name", F.lit("")), F.when(F.col("article_no").isNotNull(), F.concat(F.lit(" 第"), F.col("article_no"), F.lit("条"))).otherwise(F.lit("")), F.lit("]\n"))
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat(head, F.col("text")).alias("t"))))
    return once.groupBy(query).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def trace(hits: DataFrame, n: int = 10, width: int = 120) -> DataFrame:
    """query_id, trace: the first n hits with shortened texts and rounded scores."""
    row = F.struct("rank", F.col("doc_id"), F.substring("text", 1, width).alias("text"), F.round("score", 4).alias("score"))
    return hits.where(F.col("rank") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("trace"))


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, mode: str = "hybrid", fusion_name: str = "rrf", where: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by a named mode; an unknown mode or fusion is an error."""
    if fusion_name != "rrf":
        raise ValueError(f"no fusion {fusion_name!r}")
    some = docs.where(where) if where is not None else docs
    if mode == "dense":
        near = vectors.join(some.select("doc_id"), "doc_id", "left_semi") if where is not None else vectors
        return dense.search(near, queries, k, "doc_id", "vector")
    if mode in ("sparse", "bm25"):
        return bm25.search(some, queries, k)
    if mode == "hybrid":
        return hybrid(docs, vectors, queries, k, where=where).select("query_id", "doc_id", "score", F.col("final_rank").alias("rank"))
    raise ValueError(f"no mode {mode!r}")


def orchestrate(groups: DataFrame, docs: DataFrame, k_each: int = RECALL) -> DataFrame:
    """groups (group_id, merge_mode, queries array, top_k): every question of every group in one
    batched job; group_id, rank, doc_id, score, from_query. Blank questions are left out; 'fuse'
    lists are cut to the group's top_k, 'separate' ones follow each other in their order."""
    each = groups.select("group_id", "merge_mode", "top_k", F.posexplode("queries").alias("_o", "text")).where(F.trim("text") != "")
    each = each.withColumn("query_id", F.concat_ws(":", F.col("group_id").cast("string"), F.col("_o").cast("string")))
    hits = bm25.search(docs, each.select("query_id", "text"), k_each)
    lists = hits.join(broadcast_if_small(each, 1_000_000), "query_id")
    fused = fusion.fuse(lists.where("merge_mode = 'fuse'"), "group_id", "_o", "text", "doc_id", None)
    fused = fused.join(groups.select("group_id", "top_k"), "group_id").where(F.col("rank") <= F.coalesce("top_k", F.lit(8))).drop("top_k")
    apart = fusion.separate(lists.where("merge_mode = 'separate'"), "group_id", "_o")
    apart = apart.select("group_id", "doc_id", "score", F.col("text").alias("from_query"), F.col("position").alias("rank"))
    return fused.select("group_id", "doc_id", "score", "from_query", "rank").unionByName(apart)
