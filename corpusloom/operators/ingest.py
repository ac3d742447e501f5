"""From files to searchable chunks, and the rows that go with them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import embedding_key
from ..session import checkpointed, removed, small_splits
from . import chunking, store
from .commit_log import Conflict, Merge, Store
from .inverted import PACKED, SearchIndex

MESSAGE_CHARS = 20_000


@dataclass
class Ingested:
    """What a batch of documents adds: chunks (parents and children), vectors of the children,
    manifest rows. `commit` brings them into a store, and reads chunks that are `at_rest` where they are."""

    chunks: DataFrame
    vectors: DataFrame
    manifest: DataFrame
    at_rest: bool = False


def embedded(texts: DataFrame, key: str, text: str, model: str, encode: Callable[[Column], Column], cache: DataFrame | None = None) -> DataFrame:
    """key, content_hash, vector: equal texts are encoded once, those in the cache (content_hash,
    vector) not at all."""
    hashed = texts.select(key, embedding_key(model, F.coalesce(F.col(text), F.lit(""))).alias("content_hash"), F.col(text).alias("_text"))
    wanted = hashed.select("content_hash", "_text").dropDuplicates(["content_hash"])
    if cache is not None:
        wanted = wanted.join(cache.select("content_hash"), "content_hash", "left_anti")
    made = wanted.select("content_hash", encode(F.col("_text")).alias("vector"))
    known = made if cache is None else made.unionByName(cache.select("content_hash", "vector"))
    return hashed.drop("_text").join(known, "content_hash").select(key, "content_hash", "vector")


def ingest(blocks: DataFrame, documents: DataFrame, model: str, encode: Callable[[Column], Column], splitter: chunking.Splitter = chunking.Splitter(), cache: DataFrame | None = None) -> Ingested:
    """blocks of documents (doc_id, relpath, content_hash, size, folder, law_name): structural chunks
    with their metadata; children alone are embedded."""
    facts = documents.select("doc_id", "folder", "law_name", F.lit("user").alias("corpus"), F.lit("user").alias("doc_type"))
    # texts aren't dealt again for the facts: those join the rows of documents that chunks are made of
    chunks = checkpointed(chunking.structural(blocks, splitter, facts), **PACKED)
    children = chunks.where("chunk_level = 'child'")
    vectors = embedded(children, "chunk_id", "text", model, encode, cache)
    counts = children.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    manifest = documents.join(counts, "doc_id", "left").select("relpath", "doc_id", "content_hash", "size", F.current_timestamp().alias("indexed_at"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return Ingested(chunks, vectors, manifest, at_rest=True)


def commit(spark: SparkSession, batch: Ingested, path: str) -> SearchIndex:
    """Upsert a batch into the store at path, in one version: chunks, vectors, manifest and the BM25
    index of its children. Documents given again lose the chunks they don't have any more."""
    with small_splits(spark), removed(spark) as own:
        chunks = batch.chunks if batch.at_rest else checkpointed(batch.chunks, own, **PACKED)
        return _committed(Store.ensure(spark, path), chunks, checkpointed(batch.vectors, own), checkpointed(batch.manifest, own), own)


def _committed(at: Store, chunks: DataFrame, vectors: DataFrame, manifest: DataFrame, own: list[str]) -> SearchIndex:
    """These tables, all of them at rest, in one version with the index."""
    for name, rows, key in (("chunks", chunks, "chunk_id"), ("vectors", vectors, "chunk_id"), ("manifest", manifest, "relpath")):
        at.add_keyed(name, rows.schema, [key])
    index = SearchIndex.create(at, "string", "bm25", "chunk_id")
    none = [F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in vectors.columns if c != "chunk_id"]
    for _ in range(10):
        now = at.version().number
        known = at.read("chunks", now).join(manifest.select("doc_id").distinct(), "doc_id", "left_semi")
        stale = checkpointed(known.join(chunks, "chunk_id", "left_anti").select(chunks.columns), own, **PACKED)
        merges = {
            "chunks": (chunks.unionByName(stale), _replacing(chunks, stale)),
            "vectors": (vectors.unionByName(stale.select("chunk_id", *none)), _replacing(vectors, stale)),
            "manifest": (manifest, lambda old, new: store.upsert(old, new, ["relpath"])),
        }
        try:
            index.update(chunks.where("chunk_level = 'child'").select("chunk_id", "text"), stale.select("chunk_id"), also=merges, also_at_rest=list(merges), after=now)
            return index
        except Conflict:
            continue
    raise Conflict(f"others keep committing at {at.root}")


def _replacing(rows: DataFrame, stale: DataFrame) -> Merge:
    """`rows` take the place of those with their chunk_id, those of `stale` go."""
    return lambda old, _: store.upsert(store.delete(old, stale, ["chunk_id"]), rows, ["chunk_id"])


def summaries(rows: DataFrame) -> DataFrame:
    """Summaries of documents as chunks of the level 'document', whatever their level was."""
    return rows.withColumn("chunk_level", F.lit("document"))


def new_messages(rows: DataFrame, text: str = "content") -> DataFrame:
    """Messages as they are appended: without empty ones, cut to MESSAGE_CHARS."""
    return rows.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn(text, F.substring(text, 1, MESSAGE_CHARS))


def moved(rows: DataFrame, moves: DataFrame, key: str = "doc_id", folder: str = "folder") -> DataFrame:
    """Rows with the folders that `moves` (key, folder) gives; nothing is embedded again."""
    return store.patched(rows, moves.select(key, folder), [key])


# -- views -------------------------------------------------------------------------------------


def lookup(chunks: DataFrame, condition: Column, key: str = "chunk_id") -> DataFrame:
    """The one chunk that a condition names: the least by key."""
    return chunks.where(condition).orderBy(key).limit(1)


def listing(chunks: DataFrame, doc: str = "doc_id", n: int = 500) -> DataFrame:
    """The first n chunks of each document by (order, chunk_id)."""
    w = Window.partitionBy(doc).orderBy("order", "chunk_id")
    return chunks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def public_hits(hits: DataFrame, width: int = 400) -> DataFrame:
    """Hits as they are shown: shortened text, rounded score."""
    return hits.withColumn("text", F.substring("text", 1, width)).withColumn("score", F.round("score", 4))


def valid_id(column: Column) -> Column:
    return F.coalesce(column.rlike("^[0-9a-f]{32}$"), F.lit(False))


def group_stats(lists: DataFrame, group: str, query: str) -> DataFrame:
    """group, n_queries, n_results, n_distinct, error ('empty_queries' where no question is left)."""
    out = lists.groupBy(group).agg(F.count_distinct(query).alias("n_queries"), F.count("doc_id").alias("n_results"), F.count_distinct("doc_id").alias("n_distinct"))
    return out.withColumn("error", F.when(F.col("n_queries") == 0, F.lit("empty_queries")))


def mask_items(scanned: DataFrame, manual: DataFrame, keys: Sequence[str] = ("doc_id", "id")) -> DataFrame:
    """Scanned and manual items, each id once; scanned ones first."""
    both = scanned.withColumn("_src", F.lit(0)).unionByName(manual.withColumn("_src", F.lit(1)))
    return store.first_seen(both, list(keys), ["_src"]).drop("_src")


def edited(chunks: DataFrame, edits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks (doc, order, text) with edits (doc, order, texts: none deletes, one replaces, several
    split); a document's last chunk is not deleted; all are numbered anew."""
    w = Window.partitionBy(doc)
    found = chunks.join(edits.select(doc, "order", "texts"), [doc, "order"], "left")
    found = found.withColumn("texts", F.coalesce("texts", F.array("text")))
    left = F.sum(F.size("texts")).over(w)
    first = F.min("order").over(w)
    found = found.withColumn("_left", left).withColumn("_first", first)
    found = found.withColumn("texts", F.when((F.col("_left") == 0) & (F.col("order") == F.col("_first")), F.array("text")).otherwise(F.col("texts")))
    each = found.select(doc, "order", F.posexplode("texts").alias("sub", "text"))
    return chunking.reordered(each, doc)
