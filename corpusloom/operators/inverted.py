"""BM25 indexes at rest in a store: searches read the blocks of postings of the terms they ask for.

An index is five tables of a `commit_log.Store`:

* `docs` (keyed): key, part, dl, terms, tfs of each document;
* `blocks` (parts, by bucket of the term): up to BLOCK postings of a term, the best first, with the
  largest tf and the least dl among them, from which a bound of their weight follows whatever the
  statistics are. Documents are put in order in segments of SEGMENT postings about, in the task that
  reads them: postings are never shuffled, and what a task sorts doesn't grow with the table;
* `terms` and `stats` (parts): signed changes of each term's df, and of the number and length of
  documents, which add up to what a fit on all documents gives;
* `gone` (parts): keys whose postings of parts before a number are dead.

An update is one commit of all of them; `compact` writes what is alive as one part.

Search goes by bounds (MaxScore over block maxima): the first blocks of each term give every
question a score that its k-th best document has at least. Terms that can't reach that together
don't bring in documents; of the others only blocks that can reach it, with what the question's
other terms give at most, are opened; and only for documents still possible after that, the
remaining terms are added up. The result is that of scoring every document, which is done where the
bounds leave more than FEW postings to open: long questions rule out few documents, and each task
then scores those it reads and sends its best alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokens
from ..session import broadcast_if_small, checkpointed, removed, small_splits
from . import bm25, store
from .commit_log import Conflict, Merge, Store

BLOCK = 128
#: Postings of one segment, about, and buckets of terms that a new index has.
SEGMENT, BUCKETS = 1 << 20, 64
#: First blocks of a term, those of the highest bounds, that tell the least score of a question's k-th.
FIRST = 8
FEW = 200_000
#: How terms and postings are written.
PACKED = {"compression": "zstd"}
#: Blocks that a task hands over at a time.
_ROWS = 4096
#: Below a bound by less than this, a score may round to it.
_SLACK = 1e-5


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, dl, terms, tfs: the terms of each text in their order, counted within the row."""
    toks = docs.select(key, F.array_sort(tokens(F.col(text))).alias("_t"))
    heads = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    starts = toks.select(key, "_t", F.when(F.size("_t") > 0, heads).otherwise(F.array().cast("array<int>")).alias("_h"))
    ends = F.concat(F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1))), F.array(F.size("_t")))
    return starts.select(key, F.size("_t").cast("long").alias("dl"), F.transform("_h", lambda i: F.get("_t", i)).alias("terms"), F.zip_with("_h", F.slice(ends, 1, F.size("_h")), lambda a, b: b - a).alias("tfs"))


def _ordered(docs: pa.Table, avgdl: float, segment: int, block: int) -> pa.RecordBatch:
    """Blocks of the documents (key, dl, terms, tfs) of one segment, a term's best postings first, equal ones by key."""
    keys, dl, terms, tfs = (docs.column(i).combine_chunks() for i in range(4))
    doc = np.repeat(np.arange(len(docs)), pc.list_value_length(terms).to_numpy())
    words = terms.flatten().dictionary_encode()
    code, tf, dls = words.indices.to_numpy(), tfs.flatten().to_numpy(), dl.to_numpy()[doc]
    place = np.empty(len(docs), np.int64)
    place[pc.sort_indices(keys).to_numpy()] = np.arange(len(docs))
    impact = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dls / avgdl))
    order = np.lexsort((place[doc], -impact, code))
    code, tf, dls = code[order], tf[order], dls[order]
    at = np.arange(len(order))
    since = at - np.maximum.accumulate(np.where(np.r_[True, code[1:] != code[:-1]], at, 0))
    starts = np.flatnonzero(since % block == 0)
    ends = pa.array(np.r_[starts, len(order)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (keys.take(pa.array(doc[order])), pa.array(tf, pa.int32()), pa.array(dls, pa.int64()))]
    own = [np.full(len(starts), segment), since[starts] // block, np.diff(np.r_[starts, len(order)]), np.maximum.reduceat(tf, starts)]
    term = words.dictionary.take(pa.array(code[starts]))
    return pa.RecordBatch.from_arrays([term, *[pa.array(x, pa.int32()) for x in own], pa.array(np.minimum.reduceat(dls, starts), pa.int64()), *lists], names=["term", "segment", "block", "n", "max_tf", "min_dl", "keys", "tfs", "dls"])


def _segments(avgdl: float, block: int, most: int):
    """A function of batches of documents (key, dl, terms, tfs, none without terms): their blocks, by segments
    of `most` postings or more (less than twice as many beside those of one document), counted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = segment = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            made = _ordered(pa.Table.from_batches(held), avgdl, segment, block)
            yield from (made.slice(i, _ROWS) for i in range(0, len(made), _ROWS))

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
            cuts = [0, *np.flatnonzero(np.diff(ends // most)) + 1, len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(a, b - a))
                n += int(ends[b - 1] - (ends[a - 1] if a else 0))
                if n >= most:
                    yield from blocks()
                    held, n, segment = [], 0, segment + 1
        if n:
            yield from blocks()

    return run


def _weighed(asked: pa.Array, avgdl: float):
    """A function of batches of documents (key, dl, terms, tfs): key and (number, weight) of their asked terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            number = pc.index_in(batch.column(2).flatten(), value_set=asked).fill_null(-1).to_numpy()
            hit = np.flatnonzero(number >= 0)
            doc = np.repeat(np.arange(len(batch)), sizes)[hit]
            tf, dl = batch.column(3).flatten().to_numpy()[hit], batch.column(1).to_numpy()[doc]
            weight = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / avgdl))
            pairs = pa.StructArray.from_arrays([pa.array(number[hit]), pa.array(weight)], ["no", "w"])
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=len(batch)))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pairs)], names=["key", "terms"])

    return run


class SearchIndex:
    """An index by `key` in a store; its tables' names begin with `name`."""

    def __init__(self, at: Store, name: str = "bm25", key: str = "doc_id") -> None:
        self.store, self.name, self.key = at, name, key

    @classmethod
    def create(cls, at: Store, key_type: str = "long", name: str = "bm25", key: str = "doc_id", buckets: int = BUCKETS) -> SearchIndex:
        """A new empty index, or the one there is; the number of buckets is kept in the store."""
        index = cls(at, name, key)
        if index._table("meta") in at.version().tables:
            return index
        spark = at.spark
        schema = lambda ddl: spark.createDataFrame([], ddl).schema
        at.add_keyed(index._table("docs"), schema(f"{key} {key_type}, part long, dl long, terms array<string>, tfs array<int>"), [key])
        block = f"term string, segment int, block int, part long, n int, max_tf int, min_dl long, keys array<{key_type}>, tfs array<int>, dls array<long>, bucket int"
        at.add_appended(index._table("blocks"), schema(block), ["bucket"])
        at.add_appended(index._table("terms"), schema("term string, df long, bucket int"), ["bucket"])
        at.add_appended(index._table("stats"), schema("n_docs long, length long"))
        at.add_appended(index._table("gone"), schema(f"{key} {key_type}, part long"))
        at.add_appended(index._table("meta"), schema("buckets int"))
        at.commit(replaces={index._table("meta"): spark.range(1).select(F.lit(buckets).alias("buckets"))})
        return index

    def _table(self, what: str) -> str:
        return f"{self.name}_{what}"

    def _read(self, what: str, number: int | None = None) -> DataFrame:
        return self.store.read(self._table(what), number)

    @cached_property
    def _buckets(self) -> int:
        return self._read("meta").first()[0]

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self._buckets)).cast("int")

    # -- writing -----------------------------------------------------------------------------

    def _blocks(self, docs: DataFrame, part: int) -> DataFrame:
        """Blocks of documents (key, dl, terms, tfs) at rest."""
        key = self.key
        avgdl = float(docs.agg(F.avg("dl")).first()[0] or 1.0) or 1.0
        kind = docs.schema[key].dataType.simpleString()
        schema = f"term string, segment int, block int, n int, max_tf int, min_dl long, keys array<{kind}>, tfs array<int>, dls array<long>"
        made = docs.where(F.size("terms") > 0).select(key, "dl", "terms", "tfs").mapInArrow(_segments(avgdl, BLOCK, SEGMENT), schema)
        made = made.withColumn("part", F.lit(part).cast("long")).withColumn("bucket", self._bucket(F.col("term")))
        return made.sortWithinPartitions("bucket", "term", "segment", "block").select("term", "segment", "block", "part", "n", "max_tf", "min_dl", "keys", "tfs", "dls", "bucket")

    def update(self, docs: DataFrame, gone: DataFrame | None = None, text: str = "text", also: dict[str, tuple[DataFrame, Merge]] | None = None, also_at_rest: Sequence[str] = (), after: int | None = None, tries: int = 10) -> int:
        """Documents (key, text; one a key) are added or take the place of those with their keys, and
        those of the keys in `gone` go; merges of other tables of the store (`also`, their rows read from
        files if named by `also_at_rest`) belong to the same version, whose number this gives. With `after` it is a Conflict if that isn't the newest
        version any more."""
        with small_splits(self.store.spark), removed(self.store.spark) as own:
            return self._updated(checkpointed(term_counts(docs, self.key, text), own, **PACKED), gone, also or {}, also_at_rest, after, tries, own)

    def _updated(self, new: DataFrame, gone: DataFrame | None, also: dict[str, tuple[DataFrame, Merge]], also_at_rest: Sequence[str], after: int | None, tries: int, own: list[str]) -> int:
        key = self.key
        keys = new.select(key) if gone is None else new.select(key).union(gone.select(key)).distinct()
        dead = None if gone is None else gone.select(key).join(new.select(key), key, "left_anti").distinct()
        for _ in range(tries):
            now = self.store.version().number
            if after is not None and now != after:
                raise Conflict(f"version {now} came after {after}")
            part = now + 1
            near = self.store.read_near(self._table("docs"), keys, now).select(key, "dl", "terms")
            old = checkpointed(near.join(keys, key, "left_semi"), own, **PACKED)
            signed = lambda df, sign: df.select(F.explode("terms").alias("term"), F.lit(sign).cast("long").alias("df"))
            terms = signed(new, 1).union(signed(old, -1)).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            count = lambda df, sign: df.agg((sign * F.count("*")).alias("n_docs"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("length"))
            stats = count(new, 1).union(count(old, -1)).agg(F.sum("n_docs").alias("n_docs"), F.sum("length").alias("length"))
            rows = new.select(key, F.lit(part).cast("long").alias("part"), "dl", "terms", "tfs")
            if dead is not None:  # a row without terms stands for one that goes
                rows = rows.union(dead.select(key, F.lit(part).cast("long"), *[F.lit(None).cast(t) for t in ("long", "array<string>", "array<int>")]))
            merge = lambda old, new: store.upsert(old, new, [key]).where("terms is not null")
            try:
                return self.store.commit(
                    {**also, self._table("docs"): (rows, merge)},
                    {self._table("blocks"): self._blocks(new, part), self._table("terms"): self._by_bucket(terms), self._table("stats"): stats, self._table("gone"): old.select(key, F.lit(part).cast("long").alias("part"))},
                    after=now,
                    at_rest=(self._table("docs"), *also_at_rest),
                    options=PACKED,
                ).number
            except Conflict:
                continue
        raise Conflict(f"others keep committing at {self.store.root}")

    def _by_bucket(self, terms: DataFrame) -> DataFrame:
        # tasks of one bucket each, several of them where there are many terms
        return terms.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").select("term", "df", "bucket")

    def compact(self) -> int:
        """One part of what is alive, sums instead of changes."""
        with small_splits(self.store.spark):
            now = self.store.version().number
            docs = self._read("docs", now)
            terms = self._read("terms", now).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            stats = self.statistics(now).select("n_docs", "length")
            none = self._read("gone", now).limit(0)
            tables = {"blocks": self._blocks(docs, now + 1), "terms": self._by_bucket(terms), "stats": stats, "gone": none}
            parts = docs.select(self.key, F.lit(now + 1).cast("long").alias("part"), "dl", "terms", "tfs")
            merge = lambda _, new: new
            return self.store.commit({self._table("docs"): (parts, merge)}, replaces={self._table(n): t for n, t in tables.items()}, after=now, at_rest=(self._table("docs"),), options=PACKED).number

    # -- reading -----------------------------------------------------------------------------

    def statistics(self, number: int | None = None) -> DataFrame:
        """One row: n_docs, length, avgdl."""
        total = self._read("stats", number).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "length")])
        return total.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("length") / F.col("n_docs")))

    def terms(self, number: int | None = None) -> DataFrame:
        """term, df, idf as a fit on all documents gives them."""
        df = self._read("terms", number).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        stats = self.statistics(number)
        return df.crossJoin(F.broadcast(stats)).select("term", "df", bm25.idf(F.col("df"), F.col("n_docs")).alias("idf"))

    def _asked_blocks(self, asked: DataFrame, number: int) -> DataFrame:
        """Blocks of the buckets that some asked term lies in: folders that are known beforehand."""
        buckets = sorted(r[0] for r in asked.select(self._bucket(F.col("term")).alias("b")).distinct().collect())
        return self._read("blocks", number).where(F.col("bucket").isin(buckets))

    def _postings(self, blocks: DataFrame, dead: DataFrame | None, *more: str) -> DataFrame:
        """query, key, gain of each living posting of blocks (with a, the weight of its term)."""
        each = blocks.select("query_id", "part", "a", "avgdl", *more, F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p"))
        weight = bm25.document_weight(F.lit(1.0), F.col("p.tfs"), F.col("p.dls"), F.col("avgdl"))
        found = each.select("query_id", F.col("p.keys").alias(self.key), "part", (F.col("a") * weight).alias("gain"), *more)
        if dead is not None:
            found = found.join(dead, self.key, "left").where(F.col("_dead").isNull() | (F.col("part") >= F.col("_dead"))).drop("_dead")
        return found.drop("part")

    def search(self, queries: DataFrame, k: int, query: str = "query_id", text: str = "text", number: int | None = None) -> DataFrame:
        """query, key, score, rank: the k best documents of each question, as `bm25.search` gives them."""
        with small_splits(self.store.spark), removed(self.store.spark) as own:
            return checkpointed(self._searched(queries, k, query, text, self.store.version(number).number, own))

    def _searched(self, queries: DataFrame, k: int, query: str, text: str, number: int, own: list[str]) -> DataFrame:
        key = self.key
        gone = self._read("gone", number).groupBy(key).agg(F.max("part").alias("_dead"))
        dead = broadcast_if_small(gone, FEW) if gone.limit(1).count() else None
        asked = bm25.query_terms(queries.select(F.col(query).alias("query_id"), F.col(text).alias("text")), "query_id", "text")
        # (question, term) rows: each term's weight in a question, idf twice as both sides carry it
        known = self._read("terms", number).join(F.broadcast(asked.select("term").distinct()) if bm25._few(asked) else asked.select("term").distinct(), "term", "left_semi")
        df = known.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").crossJoin(F.broadcast(self.statistics(number)))
        idf = bm25.idf(F.col("df"), F.col("n_docs"))
        weighted = checkpointed(asked.join(df, "term").select("query_id", "term", "avgdl", (bm25.query_weight(idf, F.col("qtf")) * idf).alias("a")), own)
        hinted = F.broadcast if bm25._few(weighted) else lambda x: x
        bound = F.col("a") * bm25.document_weight(F.lit(1.0), F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))
        blocks = self._asked_blocks(weighted, number).join(hinted(weighted), "term").withColumn("bound", bound)

        # what a question's k-th document has at least, from the first blocks of its terms
        heads = blocks.where("block = 0")
        nth = Window.partitionBy("query_id", "term").orderBy(F.desc("bound"))
        cut = heads.select("query_id", "term", "bound").withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= FIRST).groupBy("query_id", "term").agg(F.min("bound").alias("cut"))
        first = self._postings(heads.join(hinted(checkpointed(cut, own)), ["query_id", "term"]).where("bound >= cut"), dead).groupBy("query_id", key).agg(F.sum("gain").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        least = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("score").alias("least"))
        most = blocks.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
        by_bound = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("most").over(Window.partitionBy("query_id"))
        limits = most.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))) - _SLACK)
        limits = limits.withColumn("others", total - F.col("most")).withColumn("opens", F.sum("most").over(by_bound) >= F.col("least"))
        rest = F.sum(F.when(F.col("opens"), F.lit(0.0)).otherwise(F.col("most"))).over(Window.partitionBy("query_id"))
        limits = checkpointed(limits.select("query_id", "term", "least", "others", "opens", rest.alias("rest")), own)

        limited = blocks.join(hinted(limits), ["query_id", "term"])
        opened = limited.where("opens and bound + others >= least")
        if bm25._few(weighted) and (opened.agg(F.sum("n")).first()[0] or 0) > FEW:
            return bm25.ranked(self._scanned(weighted, k, query, number), k, query, key)
        found = self._postings(opened, dead, "least", "rest").groupBy("query_id", key).agg(F.sum("gain").alias("gain"), F.any_value("least").alias("least"), F.any_value("rest").alias("rest"))
        found = checkpointed(found.where("gain + rest >= least").select("query_id", key, "gain"), own)
        more = self._postings(limited.where("not opens"), dead).join(broadcast_if_small(found.select("query_id", key), FEW), ["query_id", key], "left_semi")
        scores = found.union(more.select("query_id", key, "gain")).groupBy("query_id", key).agg(F.sum("gain").alias("score"))
        return bm25.ranked(scores.withColumnRenamed("query_id", query), k, query, key)

    def _scanned(self, weighted: DataFrame, k: int, query: str, number: int) -> DataFrame:
        """query, key, score: every document scored where its terms are read, of which each task sends its best."""
        rows, key = weighted.toArrow(), self.key
        numbers: dict = {}
        asks = np.array([numbers.setdefault(x, len(numbers)) for x in rows.column("query_id").to_pylist()], dtype=np.int64)
        ids = pa.array(list(numbers), type=rows.schema.field("query_id").type)
        words = rows.column("term").combine_chunks().dictionary_encode()
        term = words.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(words.dictionary)))]
        score = bm25._scorer(starts, asks[order], rows.column("a").to_numpy()[order], ids, k, (query, key))
        weigh = _weighed(words.dictionary, rows.column("avgdl")[0].as_py())
        docs = self._read("docs", number).select(key, "dl", "terms", "tfs")
        schema = StructType([StructField(query, weighted.schema["query_id"].dataType), StructField(key, docs.schema[key].dataType), StructField("score", DoubleType())])
        return docs.mapInArrow(lambda batches: score(weigh(batches)), schema)


def build(at: Store, docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "bm25", buckets: int = BUCKETS, batches: Sequence[DataFrame] = ()) -> SearchIndex:
    """An index of documents, further batches of which are updates."""
    types: StructType = docs.schema
    index = SearchIndex.create(at, types[key].dataType.simpleString(), name, key, buckets)
    for some in (docs, *batches):
        index.update(some, text=text)
    return index
