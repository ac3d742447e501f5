"""Quality by hierarchical empirical Bayes.

A logistic classifier over the form of a text gives its evidence. Grouped sums of that evidence
give each host, and each path within a host, a posterior: a path is shrunk toward its host and a
host toward all documents, the more the sparser it is; how strongly follows from the spread of
the groups (method of moments). The score of a document joins its own evidence with the
posterior of its path, from which the document itself is left out.

Labels, language, source and doc_id are no input of the evidence; host and path choose groups
only. Defined results: null and empty texts have the evidence of an empty text; null hosts and
paths are groups of their own; without usable labels the evidence is one half everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _io as io
from .toxicity import held_out, labelled_sample, logistic

#: Labelled rows that the classifier may see, taken in the order of a hash of doc_id.
SAMPLE_ROWS = 4000
THRESHOLD = 0.5
BROADCAST_BYTES = 32 << 20
N_FIGURES = 13
_SIGNS = np.frombuffer(b"#$%&*|~^=<>\\_{}[]", dtype=np.uint8)


def figures(text: str | None) -> list[float]:
    """The form of a text in numbers, none of which depends on its language's words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw) + 1
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    w = len(words) + 1
    lines = [x for x in raw.split(b"\n") if x]
    upper, lower = byte[65:91].sum(), byte[97:123].sum()
    stuck = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        byte[_SIGNS].sum() / n,
        byte[[33, 63]].sum() / n,
        byte[48:58].sum() / n,
        upper / (upper + lower + 1),
        byte[[44, 46, 59, 58]].sum() / w,
        byte[124] / w,
        min(20.0, (len(raw) - len(words)) / w) / 10,
        len(set(words)) / w,
        stuck / w,
        1 - len(set(lines)) / (len(lines) + 1e-9) if lines else 0.0,
        float(np.log1p(len(words))),
        float(np.log1p(len(lines))),
        byte[128:].sum() / n,
    ]


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(sample: list[tuple[str, int]]) -> Model | None:
    y = np.array([y for _, y in sample], dtype=float)
    if len(y) < 40 or min(y.sum(), len(y) - y.sum()) < 5:
        return None
    return logistic(np.array([_spread(figures(t)) for t, _ in sample]), y)


def _spread(x: list[float]) -> list[float]:
    """Figures and the square roots of the shares, so that few signs tell too."""
    return x + [v**0.5 for v in x[:6]] + [x[7] ** 4, x[10] ** 2]


def evidence(docs: DataFrame, model: Model | None, carry: list[str]) -> DataFrame:
    """doc_id, the columns `carry`, and evidence: the classifier's probability of quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            p = np.full(len(batch), 0.5)
            if own and len(batch):
                mean, scale, w = own
                x = (np.array([_spread(figures(t.as_py())) for t in batch.column(1)]) - mean) / scale
                p = 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(p, pa.float64())], names=["doc_id", *carry, "evidence"])

    kinds = ", ".join(f"`{c}` string" for c in carry)
    return io.in_batches(docs, run, f"doc_id long, {kinds + ', ' if kinds else ''}evidence double")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(mean: float, within: float, between: float) -> float:
    """Documents that a group needs to count as much as what it is shrunk to."""
    return float(np.clip(within / between, 1.0, 1e4)) if between > 1e-9 else 1e4


def _spread_of(groups: DataFrame, mean: Column, n: str, total: str) -> tuple[float, float]:
    """(variance of documents within groups, variance of the groups' true means)."""
    m = F.col(total) / F.col(n)
    row = groups.agg(F.sum(F.col("squares") - F.col(total) * m).alias("within"), F.sum(F.col(n) * (m - mean) ** 2).alias("apart"), F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not row["n"] or row["g"] < 2 or row["n"] <= row["g"]:
        return 0.0, 0.0
    within = max(row["within"], 0.0) / (row["n"] - row["g"])
    size = (row["n"] - row["nn"] / row["n"]) / (row["g"] - 1)
    return within, max(0.0, (row["apart"] / (row["g"] - 1) - within) / size)


def combine(rows: DataFrame, host: str, path: str) -> DataFrame:
    """rows (doc_id, host, path, evidence) with path_posterior, host_posterior and score.

    Hosts and paths are far fewer than documents; their sums come from map-side partial sums and are
    written once. A group that holds very many rows is one row on the other side of the join; groups
    are broadcast if a sum of their bytes is at most BROADCAST_BYTES, beyond that adaptive execution
    splits the hot ones.
    """
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("total"), F.sum(F.col("evidence") ** 2).alias("squares")]
    paths = io.written(rows.groupBy(host, path).agg(*sums), "paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = whole["total"] / whole["n"] if whole["n"] else 0.5
    k_host = strength(mean, *_spread_of(hosts, F.lit(mean), "n", "total"))
    hosts = hosts.select(F.col(host).alias("_host"), F.col("n").alias("_hn"), F.col("total").alias("_ht"))
    named = paths.join(hosts, F.col(host).eqNullSafe(F.col("_host")))
    k_path = strength(mean, *_spread_of(named, F.col("_ht") / F.col("_hn"), "n", "total"))
    groups = named.select(F.col("_host"), F.col(path).alias("_path"), "_hn", "_ht", F.col("n").alias("_n"), F.col("total").alias("_t"))
    names = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("_host", "_path")]
    size = groups.agg(F.sum(48 + names[0] + names[1])).first()[0] or 0
    joined = rows.join(F.broadcast(groups) if size <= BROADCAST_BYTES else groups, F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path")))
    own = F.col("evidence")
    host_posterior = (F.col("_ht") - own + k_host * mean) / (F.col("_hn") - 1 + k_host)
    joined = joined.withColumn("host_posterior", host_posterior)
    joined = joined.withColumn("path_posterior", (F.col("_t") - own + k_path * F.col("host_posterior")) / (F.col("_n") - 1 + k_path))
    score = 1 / (1 + F.exp(-(_logit(own) + _logit(F.col("path_posterior")) - _logit(F.lit(mean)))))
    return joined.withColumn("score", score).select("doc_id", host, path, "evidence", "host_posterior", "path_posterior", "score")


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, evidence, host_posterior, path_posterior, score, predicted (1: good), keep."""
    rows = io.written(evidence(docs, fit(labelled_sample(docs, labels, "quality", most)), [host, path]), "evidence")
    found = combine(rows, host, path)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("keep"))
