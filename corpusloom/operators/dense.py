"""Exact vector search: a stated query set, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors in a block; a block meets every batch of rows in one product.
BLOCK = 1024
#: Bytes of query vectors that are broadcast together, block by block, for one reading of the rows.
PASS = 64 << 20


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector, their vectors as float64)."""
    rows = np.flatnonzero(np.asarray(column.is_valid()))
    flat = column.take(pa.array(rows)).flatten()
    return rows, np.asarray(flat, dtype=np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays as it is, so that its cosine is 0."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def quantised(x: np.ndarray, how: str) -> np.ndarray:
    """Rows in coarse steps: 127 either way of the largest number ('int8'), or signs ('binary')."""
    if how == "binary":
        return np.sign(x).astype(np.float32)
    largest = np.abs(x).max(axis=1, keepdims=True)
    return np.round(x / np.where(largest > 0, largest, 1.0) * 127).astype(np.float32)


def _near(blocks: Broadcast, k: int, normalise: bool, query_type: pa.DataType, key_type: pa.DataType, coarse: str | None = None, oversample: int = 4) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(ids, queries, quantised(queries, coarse) if coarse else None) for ids, queries in blocks.value]
        for batch in batches:
            rows, x = _matrix(batch.column(1))
            if not len(rows):
                continue
            x = unit(x) if normalise else x
            keys = batch.column(0).take(pa.array(rows))
            steps = quantised(x, coarse) if coarse and len(rows) > oversample * k else None
            for ids, queries, rough in held:
                if steps is not None:
                    # the best by coarse vectors, in single precision; only these are scored exactly
                    by = rough @ steps.T
                    near = np.argpartition(-by, oversample * k - 1, axis=1)[:, : oversample * k]
                    s = np.full(by.shape, -np.inf)
                    np.put_along_axis(s, near, np.round(np.einsum("qd,qnd->qn", queries, x[near]), 6), axis=1)
                else:
                    s = np.round(queries @ x.T, 6)
                # only the k best of a batch (and what ties with the last of them) can be among the k best
                if s.shape[1] > k:
                    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    q, r = np.nonzero((s >= edge) & np.isfinite(s))
                else:
                    q, r = (g.ravel() for g in np.indices(s.shape))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], query_type), keys.take(pa.array(r)), pa.array(s[q, r])], names=["q", "k", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query: str = "query_id", query_vector: str = "vector", normalise: bool = True, coarse: str | None = None, oversample: int = 4) -> DataFrame:
    """query, key, score (cosine, or inner product unless `normalise`; six digits), rank from 1.

    With `coarse` ('int8' or 'binary') each batch first picks `oversample` * k rows by coarse
    vectors and scores these exactly; that may miss some of the k best. The vectors of the rows are
    read once for every PASS bytes of query vectors.
    """
    if coarse not in (None, "int8", "binary"):
        raise ValueError(f"no coarse vectors {coarse!r}")
    spark = rows.sparkSession
    key_sql, query_sql = rows.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    types = to_arrow_type(queries.schema[query].dataType), to_arrow_type(rows.schema[key].dataType)
    parts, blocks, held = [], [], []

    def block() -> None:
        x = np.array([r[1] for r in held], dtype=np.float64)
        blocks.append(([r[0] for r in held], unit(x) if normalise else x))
        held.clear()

    def reading() -> None:
        run = _near(spark.sparkContext.broadcast(list(blocks)), k, normalise, *types, coarse, oversample)
        parts.append(rows.select(key, vector).mapInArrow(run, f"q {query_sql}, k {key_sql}, score double"))
        blocks.clear()

    for r in queries.select(query, query_vector).where(F.col(query_vector).isNotNull()).toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            block()
            if sum(x.nbytes for _, x in blocks) >= PASS:
                reading()
    if held:
        block()
    if blocks:
        reading()
    if not parts:
        return spark.createDataFrame([], f"{query} {query_sql}, {key} {key_sql}, score double, rank int")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "k")
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias(query), F.col("k").alias(key), "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in the JVM; 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
