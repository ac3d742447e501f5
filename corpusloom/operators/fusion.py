"""Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(dense: DataFrame, sparse: DataFrame, query: str, key: str, k: int, constant: int = RRF_K) -> DataFrame:
    """Two arms (query, key, rank): score = sum of 1 / (constant + rank); equal scores in the order
    of the dense ranks, then the sparse ones."""
    both = dense.select(query, key, F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"))
    both = both.unionByName(sparse.select(query, key, F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank")))
    one = both.groupBy(query, key).agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    one = one.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 6))
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), key)
    return one.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)


def fuse(lists: DataFrame, group: str, order: str, name: str, key: str, k: int | None, constant: int = RRF_K) -> DataFrame:
    """The lists (rows with `order`, rank) of each group fused: key, score, from_query (names of
    the lists in their order). Equal scores by the first list and rank that has the key."""
    first = F.min(F.struct(order, "rank")).alias("_first")
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col(name).cast("string").alias("n")))), lambda x: x["n"]), ";")
    one = lists.groupBy(group, key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"), names.alias("from_query"), first)
    w = Window.partitionBy(group).orderBy(F.desc("score"), "_first", key)
    one = one.withColumn("rank", F.row_number().over(w))
    return (one.where(F.col("rank") <= k) if k else one).drop("_first")


def separate(lists: DataFrame, group: str, order: str) -> DataFrame:
    """The lists of each group after one another, repeats kept: position from 1."""
    w = Window.partitionBy(group).orderBy(order, "rank")
    return lists.withColumn("position", F.row_number().over(w))


def summed(lists: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """Scores of a key added over the lists of a group."""
    one = lists.groupBy(group, key).agg(F.round(F.sum("score"), 6).alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
