"""A vector index at rest: cells of a coarse quantiser as folders, product-quantised codes in them.

`build` fits the cells and the code books by k-means in Spark jobs over a sample of about
SAMPLE_ROWS rows (chosen by hash of the key), indexes every row, and measures how many cells a
question has to visit: for a sample of rows as questions it finds the true neighbours among all
rows and takes the rank of the cell that holds them which `target` of them don't exceed.

A search visits the folders of its questions' nearest cells and reads keys and codes alone there:
a table of inner products with the code books, one a question, scores a code. The best
`oversample` * k candidates of each question are then scored exactly on their vectors. Questions
for which fewer than k rows are found are answered by exact search, as all are with exact=True.

Vectors are taken by direction (cosine); null ones are left out, zero ones have cosine 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpointed
from . import dense
from .commit_log import Store

SAMPLE_ROWS, SAMPLE_QUESTIONS = 65_536, 256
CODES = 256
#: Rows of a cell in one file, about.
FILE_ROWS = 1 << 20
FEW = 1_000_000


def _sample(rows: DataFrame, most: int, total: int, salt: int) -> DataFrame:
    """About `most` rows, chosen by hash of the key."""
    return rows.where(F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1_000_003)) < F.lit(max(1, 1_000_003 * most // max(total, 1))))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def _blocks(x: np.ndarray, parts: int) -> np.ndarray:
    """Vectors cut into `parts` pieces of equal size, filled up with zeros: (parts, rows, size)."""
    size = -(-x.shape[1] // parts)
    padded = np.pad(x, ((0, 0), (0, size * parts - x.shape[1])))
    return padded.reshape(len(x), parts, size).transpose(1, 0, 2)


def _kmeans(sample: DataFrame, pieces: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int) -> np.ndarray:
    """Centres (group, number, size) for each group of pieces of the vectors. Each round is a job;
    sums by (group, number, place), as many as the centres have numbers, come back from it."""
    centres = start
    for _ in range(rounds):
        held = sample.sparkSession.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], held: Any = held) -> Iterator[pa.RecordBatch]:
            now = held.value
            sums, counts = np.zeros(now.shape), np.zeros(now.shape[:2], dtype=np.int64)
            for batch in batches:
                _, x = dense._matrix(batch.column(0))
                for g, piece in enumerate(pieces(dense.unit(x)) if len(x) else []):
                    near = _nearest(piece, now[g])
                    np.add.at(sums[g], near, piece)
                    np.add.at(counts[g], near, 1)
            g, c, i = (a.ravel() for a in np.indices(now.shape))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(i), pa.array(counts[g, c]), pa.array(sums[g, c, i])], names=["g", "c", "i", "n", "s"])

        found = sample.select("vector").mapInArrow(run, "g long, c long, i long, n long, s double").groupBy("g", "c", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").toPandas()
        centres = centres.copy()
        centres[found.g, found.c, found.i] = found.s / found.n
        held.destroy()
    return centres


class VectorIndex:
    def __init__(self, at: Store, name: str = "vectors") -> None:
        self.store, self.name = at, name

    @cached_property
    def _model(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(cells, code books, cells to visit); its size doesn't depend on the rows."""
        row = self.store.read(f"{self.name}_model").first()
        return np.array(row["cells"]), np.array(row["books"]), row["probes"]

    @property
    def cells(self) -> int:
        return len(self._model[0])

    @property
    def probes(self) -> int:
        return self._model[2]

    def rows(self) -> DataFrame:
        """key, codes, vector, cell."""
        return self.store.read(f"{self.name}_rows")

    @classmethod
    def build(cls, at: Store, rows: DataFrame, key: str, vector: str, cells: int = 64, parts: int = 16, rounds: int = 8, target: float = 0.95, near: int = 10, name: str = "vectors") -> VectorIndex:
        spark, key_type = rows.sparkSession, rows.schema[key].dataType.simpleString()
        rows = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).where("vector is not null")
        total = rows.count()
        sample = checkpointed(_sample(rows, SAMPLE_ROWS, total, 1))
        first = lambda n: np.array([r.vector for r in _sample(sample, 4 * n, total, 2).orderBy(F.xxhash64("key")).limit(n).collect()], dtype=np.float64)
        some = dense.unit(first(max(cells, CODES))) if total else np.zeros((1, 1))
        coarse = _kmeans(sample, lambda x: x[None], some[:cells][None], rounds)[0]
        rest = lambda x: _blocks(x - coarse[_nearest(x, coarse)], parts)
        books = _kmeans(sample, rest, rest(some[:CODES]), rounds)
        held = spark.sparkContext.broadcast((coarse, books))

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell_centres, code_books = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                _, x = dense._matrix(batch.column(1))
                x = dense.unit(x)
                cell = _nearest(x, cell_centres)
                codes = np.stack([_nearest(p, b) for p, b in zip(_blocks(x - cell_centres[cell], len(code_books)), code_books, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(cell, pa.int32())], names=["key", "codes", "vector", "cell"])

        schema = f"key {key_type}, codes binary, vector array<float>, cell int"
        at.add_appended(f"{name}_rows", spark.createDataFrame([], schema).schema, ["cell"])
        at.add_appended(f"{name}_model", spark.createDataFrame([], "cells array<array<double>>, books array<array<array<double>>>, probes int").schema)
        files = max(1, -(-total // (len(coarse) * FILE_ROWS)))
        dealt = rows.mapInArrow(encoded, schema).repartition("cell", F.pmod(F.xxhash64("key"), F.lit(files)))
        at.commit(replaces={f"{name}_rows": dealt})
        index = cls(at, name)
        index._model = coarse, books, len(coarse)
        probes = index._needed(_sample(rows, SAMPLE_QUESTIONS, total, 3), near, target) if total else 0  # of no rows there is nothing to visit
        model = spark.createDataFrame([(coarse.tolist(), books.tolist(), probes)], "cells array<array<double>>, books array<array<array<double>>>, probes int")
        at.commit(replaces={f"{name}_model": model})
        return cls(at, name)

    def _needed(self, asked: DataFrame, near: int, target: float) -> int:
        """Cells that hold `target` of the true neighbours of the rows asked, nearest cells first."""
        asked = checkpointed(asked)
        true = dense.search(self.rows().withColumnRenamed("key", "row"), asked.withColumnRenamed("key", "query_id"), near, "row", "vector")
        cells = true.join(self.rows().select(F.col("key").alias("row"), "cell"), "row").select("query_id", "cell").collect()  # a bounded sample's
        order = {r.key: np.argsort(np.argsort(-self._cell_scores(np.array([r.vector], dtype=np.float64))[0])) for r in asked.collect()}
        ranks = sorted(int(order[r.query_id][r.cell]) + 1 for r in cells)
        return ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))] if ranks else 1

    def _cell_scores(self, x: np.ndarray) -> np.ndarray:
        centres = self._model[0]
        return dense.unit(x) @ centres.T - 0.5 * (centres * centres).sum(axis=1)

    def search(self, queries: DataFrame, k: int, query: str = "query_id", vector: str = "vector", probes: int | None = None, oversample: int = 20, exact: bool = False) -> DataFrame:
        """query, key, score (cosine, six digits), rank of the k nearest rows, nearly always."""
        asked = queries.select(F.col(query).alias("query_id"), F.col(vector).alias("vector")).where("vector is not null")
        plain = lambda some: dense.search(self.rows(), some, k, "key", "vector").select("query_id", "key", "score", "rank")
        if exact or not self.probes:
            return plain(asked).withColumnRenamed("query_id", query)
        asked = checkpointed(asked)
        found = checkpointed(self._scored(self._candidates(asked, oversample * k, min(probes or self.probes, self.cells)), asked, k))
        whole = found.groupBy("query_id").count().where(F.col("count") >= k)
        rest = asked.join(whole, "query_id", "left_anti")
        out = found.join(whole, "query_id", "left_semi").unionByName(plain(rest)) if rest.limit(1).count() else found
        return out.withColumnRenamed("query_id", query)

    def _candidates(self, asked: DataFrame, most: int, probes: int) -> DataFrame:
        """query_id, key, cell: of each question the best by their codes, in the cells it visits."""
        coarse, books, _ = self._model
        spark, parts = asked.sparkSession, []
        key_type, query_type = self.rows().schema["key"].dataType, asked.schema["query_id"].dataType
        held: list[Any] = []

        def reading() -> None:
            x = dense.unit(np.array([r.vector for r in held], dtype=np.float64))
            visits = np.argsort(-self._cell_scores(x), axis=1)[:, :probes]
            shared = spark.sparkContext.broadcast(([r.query_id for r in held], x, visits, coarse, books))
            near = self.rows().select("key", "cell", "codes").where(F.col("cell").isin(sorted({int(c) for c in visits.ravel()})))
            parts.append(near.mapInArrow(_by_codes(shared, most, key_type, query_type), f"query_id {query_type.simpleString()}, key {key_type.simpleString()}, cell int, score double"))
            held.clear()

        for r in asked.toLocalIterator():
            held.append(r)
            if len(held) == dense.BLOCK:
                reading()
        if held:
            reading()
        if not parts:
            return spark.createDataFrame([], f"query_id {query_type.simpleString()}, key {key_type.simpleString()}, cell int")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return reduce(DataFrame.unionByName, parts).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("query_id", "key", "cell")

    def _scored(self, candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        candidates = checkpointed(candidates)
        cells = sorted(r[0] for r in candidates.select("cell").distinct().collect())  # cells, not rows
        rows = self.rows().select("key", "cell", "vector").where(F.col("cell").isin(cells))
        pairs = rows.join(broadcast_if_small(candidates, FEW), ["key", "cell"]).join(broadcast_if_small(asked.withColumnRenamed("vector", "_q"), 10_000), "query_id")
        scored = pairs.select("query_id", "key", F.round(dense.cosine(F.col("_q"), F.col("vector")), 6).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _by_codes(shared: Any, most: int, key_type: Any, query_type: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_type

    query_arrow = to_arrow_type(query_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, visits, coarse, books = shared.value
        # for each question the inner product of its pieces with every code
        tables = np.einsum("pqs,pcs->qpc", _blocks(x, len(books)), books)
        visitors = [np.flatnonzero((visits == c).any(axis=1)) for c in range(len(coarse))]
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                own, who = np.flatnonzero(cells == cell), visitors[cell]
                if not len(who):
                    continue
                codes = np.frombuffer(b"".join(batch.column("codes").take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
                score = x[who] @ coarse[cell][:, None] + np.zeros((1, len(own)))
                for p in range(codes.shape[1]):
                    score += tables[who, p][:, codes[:, p]]
                if len(own) > most:
                    edge = -np.partition(-score, most - 1, axis=1)[:, most - 1 : most]
                    q, r = np.nonzero(score >= edge)
                else:
                    q, r = (g.ravel() for g in np.indices(score.shape))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in who[q]], query_arrow), batch.column("key").take(pa.array(own[r])), pa.array(np.full(len(q), cell), pa.int32()), pa.array(score[q, r])], names=["query_id", "key", "cell", "score"])

    return run
