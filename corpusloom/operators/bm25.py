"""BM25 over plain tables: statistics, weights, batched search.

Score = sum over shared terms of document weight times query weight, both of which carry the
idf; `classic` leaves the idf out of the query weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokens

K1, B = 1.5, 0.75
#: Query rows (query, term) that are broadcast at most; beyond, terms meet in a shuffled join.
MAX_QUERY_ROWS = 200_000
#: Characters of text, and pairs of a question and a document, that one task counts, about: hash tables
#: of terms grow with these and not with the table.
TASK_CHARS, TASK_PAIRS = 8_000_000, 2_000_000
#: Cells and products that a batch of documents is scored in.
_CELLS = 1 << 21
#: Scores this close may be equal once they are rounded to six digits.
_SLACK = 1.1e-6


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def document_weight(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_weight(idf_: Column, qtf: Column, k1: float = K1, classic: bool = False) -> Column:
    w = (k1 + 1) * qtf / (k1 + qtf)
    return w if classic else idf_ * w


@dataclass
class Index:
    """postings(key, term, tf, dl), terms(term, df, idf), stats(n_docs, avgdl)."""

    key: str
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        for name in ("postings", "terms", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str, key: str) -> Index:
        return cls(key, *(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "stats")))


def tokenised(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, toks, dl; texts without tokens have length 0."""
    return docs.select(key, tokens(F.col(text)).alias("toks")).withColumn("dl", F.size("toks").cast("long"))


def statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    return tokenised(docs, key, text).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def _counted(docs: DataFrame, text: str) -> tuple[int, float | None, int]:
    """One pass over the texts: n_docs, avgdl, and the number of tasks that their terms are counted in."""
    dl = F.size(tokens(F.col(text)))
    n, avgdl, chars = docs.select(dl.alias("dl"), F.length(text).alias("n")).agg(F.count("*"), F.avg("dl"), F.sum("n")).first()
    return n, avgdl, max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(chars or 0) // TASK_CHARS))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: DataFrame | None = None) -> Index:
    """Fitting anew on all documents is the only way to add some: no stale vocabulary. With `wanted` (term)
    postings and terms are those of the wanted terms alone, the statistics those of all texts."""
    n_docs, avgdl, tasks = _counted(docs, text)
    if wanted is None:
        # dealt by document, so that counting its terms needs no exchange of postings
        toks = tokenised(docs.select(key, text).repartition(tasks, key), key, text)
        each = toks.select(key, "dl", F.explode("toks").alias("term"))
    else:
        each = _hits(docs, wanted.select("term").distinct(), key, text, tasks, [], _few(wanted))
    postings = each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    stats = docs.sparkSession.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(avgdl).cast("double").alias("avgdl"))
    # one row a document and term: counting is enough, and is done in part before the exchange
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.select("term", "df", idf(F.col("df"), F.lit(n_docs).cast("long")).alias("idf"))
    return Index(key, postings, terms, stats)


def weights(index: Index) -> DataFrame:
    """postings with the document weight of each term."""
    w = index.postings.join(index.terms, "term").crossJoin(F.broadcast(index.stats))
    return w.select(index.key, "term", "tf", "dl", "idf", document_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("weight"))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """query, term, qtf."""
    return queries.select(query, F.explode(tokens(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))


def _few(asked: DataFrame) -> bool:
    return asked.limit(MAX_QUERY_ROWS + 1).count() <= MAX_QUERY_ROWS


def _hits(docs: DataFrame, wanted: DataFrame, key: str, text: str, tasks: int, more: list[str], few: bool) -> DataFrame:
    """key, more, dl and wanted's columns, a row for each token of a wanted term, dealt by document. Few terms
    are broadcast and the texts dealt: as rows of tokens a scan's split takes several times their memory to deal."""
    rows = docs.select(key, *more, text)
    toks = (rows.repartition(tasks, key) if few else rows).select(key, *more, tokens(F.col(text)).alias("toks")).withColumn("dl", F.size("toks").cast("long"))
    # for `explode` the scan would cut every text into tokens too, to leave out those without any
    each = toks.select(key, *more, "dl", F.explode_outer("toks").alias("term"))
    return each.join(F.broadcast(wanted), "term") if few else each.join(wanted, "term").repartition(tasks, key)


def _asked_counts(docs: DataFrame, wanted: DataFrame, key: str, text: str, tasks: int, more: list[str], few: bool) -> DataFrame:
    """key, more, dl, term, tf of the wanted terms alone, dealt by document: neither counting a document's
    terms nor adding up its scores moves rows again."""
    hits = _hits(docs, wanted, key, text, tasks, more, few)
    rest = [c for c in wanted.columns if c != "term"]
    return hits.groupBy(key, *more, "dl", *(rest or ["term"])).agg(F.count("*").alias("tf"))


def scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "text", classic: bool = False, within: DataFrame | None = None) -> DataFrame:
    """query, key, score of every document that shares a term, straight from the texts; with `within`
    (query and a column of docs) only of documents that have the question's values of that column,
    whereas the statistics are those of all.

    The terms are broadcast (after a count of the questions' terms alone), documents reduced to
    (document, term) counts, which feed both the idf of these terms and the scores.
    """
    asked = query_terms(queries, query, query_text)
    few = _few(asked)
    hinted = F.broadcast if few else lambda df: df
    n_docs, avgdl, tasks = _counted(docs, text)
    tasks = max(tasks, -(-n_docs * asked.select(query).distinct().count() // TASK_PAIRS))
    more = [] if within is None else [c for c in within.columns if c != query]
    tf = _asked_counts(docs, asked.select("term").distinct(), key, text, tasks, more, few)
    df = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", idf(F.col("df"), F.lit(n_docs).cast("long")).alias("idf"))
    # no more rows than the questions have terms, a value of `within` each
    asked = asked.join(df, "term").select(query, "term", "idf", query_weight(F.col("idf"), F.col("qtf"), classic=classic).alias("wq"))
    if within is not None:
        asked = asked.join(within.distinct(), query)
    w = document_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(avgdl).cast("double"))
    return tf.join(hinted(asked), ["term", *more]).groupBy(query, key).agg(F.sum(F.col("wq") * w).alias("score"))


def ranked(found: DataFrame, k: int, query: str, key: str, digits: int | None = 6) -> DataFrame:
    """The k best of each query with their rank from 1; equal scores by key."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    w = Window.partitionBy(query).orderBy(F.desc("_s"), key)
    return found.withColumn("_s", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, key, F.col("_s").alias("score"), "rank")


def _best(rows: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """rows (query number, key, score) that may be among the k best of their question once scores are
    rounded: k rows, and what is no further off than _SLACK, of equal scores the k least keys. Besides,
    the questions that have k rows and the least score of these."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start"))
    q, score = (rows.column(c).to_numpy() for c in ("q", "score"))
    at = np.arange(len(q))
    new_q = np.r_[True, q[1:] != q[:-1]]
    new_score = new_q | np.r_[True, score[1:] != score[:-1]]
    rank, again = (at - np.maximum.accumulate(np.where(new, at, 0)) for new in (new_q, new_score))
    kth = np.flatnonzero(rank == k - 1)
    least = np.full(int(q[-1]) + 1, -np.inf)
    least[q[kth]] = score[kth]
    return rows.filter(pa.array((rank < k) | ((score >= least[q] - _SLACK) & (again < k)))), q[kth], score[kth]


def _scorer(starts: np.ndarray, asks: np.ndarray, gains: np.ndarray, ids: pa.Array, k: int, names: tuple[str, str]):
    """A function of batches of documents (key, terms [(number, weight)]): each task's best of every question.
    Term t is asked by the questions asks[starts[t]:starts[t + 1]] with these gains."""
    n_queries, counts = len(ids), np.diff(starts)

    def blocks(first: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        products, rows = np.r_[0, np.cumsum(counts[numbers])][first], max(1, _CELLS // n_queries)
        a = 0
        while a < len(first) - 1:
            b = min(a + rows, int(np.searchsorted(products, products[a] + _CELLS, "right")) - 1, len(first) - 1)
            yield a, (b := max(b, a + 1))
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, floor = [], 0, np.full(n_queries, -np.inf)

        def reduced() -> None:
            nonlocal held, n_held
            table, q, score = _best(pa.concat_tables(held), k)
            floor[q] = score
            held, n_held = [table], len(table)

        limit = 0
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            first = np.asarray(lists.offsets)
            numbers, weights_ = (np.asarray(lists.values.field(i)) for i in (0, 1))
            numbers, weights_, first = numbers[first[0] : first[-1]], weights_[first[0] : first[-1]], first - first[0]
            for a, b in blocks(first, numbers):
                t, w = numbers[first[a] : first[b]], weights_[first[a] : first[b]]
                n = counts[t]
                term = np.repeat(np.arange(len(t)), n)
                place = starts[t][term] + np.arange(len(term)) - (np.cumsum(n) - n)[term]
                row = np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))[term]
                cells = np.bincount(row * n_queries + asks[place], gains[place] * w[term], (b - a) * n_queries).reshape(b - a, n_queries)
                d, q = np.nonzero((cells > 0) & (cells >= floor - _SLACK))
                held.append(pa.table({"q": q, "key": keys.take(pa.array(a + d)), "score": cells[d, q]}))
                n_held += len(d)
                if n_held > limit:
                    reduced()
                    limit = 2 * n_held + _CELLS // 8
        if n_held:
            reduced()
            for some in held[0].to_batches(max_chunksize=10_000):
                yield pa.RecordBatch.from_arrays([ids.take(some.column(0)), some.column(1), some.column(2)], [*names, "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "text", classic: bool = False) -> DataFrame:
    """The k best documents of each question. Each task scores its documents in batches and sends its best
    alone; more than MAX_QUERY_ROWS rows of questions and terms are joined instead."""
    asked = query_terms(queries, query, query_text)
    if not _few(asked):
        return ranked(scores(docs, queries, key, text, query, query_text, classic), k, query, key)
    spark, rows = docs.sparkSession, asked.toArrow()
    numbers: dict = {}
    asks = np.array([numbers.setdefault(x, len(numbers)) for x in rows.column(query).to_pylist()], dtype=np.int64)
    ids = pa.array(list(numbers), type=rows.schema.field(query).type)
    terms: dict[str, int] = {}
    term = np.array([terms.setdefault(x, len(terms)) for x in rows.column("term").to_pylist()], dtype=np.int64)
    qtf, order = rows.column("qtf").to_numpy(), np.argsort(term, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(terms)))]
    gains = (K1 + 1) * qtf / (K1 + qtf)

    n_docs, avgdl, tasks = _counted(docs, text)
    wanted = spark.createDataFrame(list(terms.items()), "term string, _no int")
    tf = _asked_counts(docs, wanted, key, text, tasks, [], True)
    df = tf.groupBy("_no").agg(F.count("*").alias("df")).select("_no", idf(F.col("df"), F.lit(n_docs).cast("long")).alias("idf"))
    # both sides carry the idf, here the document's alone does
    weight = document_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(avgdl).cast("double")) * (F.lit(1.0) if classic else F.col("idf"))
    each = tf.join(F.broadcast(df), "_no").groupBy(key).agg(F.collect_list(F.struct("_no", weight.alias("w"))).alias("terms"))
    schema = StructType([StructField(query, asked.schema[query].dataType), StructField(key, docs.schema[key].dataType), StructField("score", DoubleType())])
    found = each.mapInArrow(_scorer(starts, asks[order], gains[order], ids, k, (query, key)), schema)
    return ranked(found, k, query, key)


def diagnostics(index: Index, queries: DataFrame, query: str, text: str) -> DataFrame:
    """One row a token of a question: token, idf, is_oov, score (weight in the question), freq."""
    toks = queries.select(query, tokens(F.col(text)).alias("t"))
    each = toks.select(query, F.posexplode("t").alias("pos", "token"))
    freq = each.groupBy(query, "token").agg(F.count("*").alias("freq"))
    wanted = freq.select(F.col("token").alias("term")).distinct()
    known = index.terms.join(wanted, "term", "left_semi")
    out = each.join(freq, [query, "token"]).join(known.withColumnRenamed("term", "token"), "token", "left")
    weight = query_weight(F.col("idf"), F.col("freq"))
    return out.select(query, "pos", "token", F.round(F.coalesce("idf", F.lit(0.0)), 4).alias("idf"), F.col("idf").isNull().alias("is_oov"), F.round(F.coalesce(weight, F.lit(0.0)), 4).alias("score"), "freq")


def okapi(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "text", epsilon: float = 0.25) -> DataFrame:
    """Okapi ranking: idf ln(N - df + 0.5) - ln(df + 0.5), negative ones replaced by epsilon times
    the mean idf; every occurrence of a term in the question counts."""
    index = fit(docs, key, text)
    # the join below asks for terms that aren't null; with the mean asking too, both read one exchange of counts
    raw = index.terms.where(F.col("term").isNotNull()).crossJoin(F.broadcast(index.stats)).withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf").alias("mean"))
    asked = query_terms(queries, query, query_text)
    few = _few(asked)
    hinted = F.broadcast if few else lambda df: df
    wanted = hinted(asked.select("term").distinct())
    terms = raw.join(wanted, "term", "left_semi").crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    w = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # tokens that no question has go before they are counted; without a broadcast that would move postings
    tf = index.postings.join(wanted, "term", "left_semi") if few else index.postings
    found = tf.join(hinted(asked.join(terms, "term")), "term").groupBy(query, key).agg(F.sum(w).alias("score"))
    return ranked(found, k, query, key)
