"""Queries over indexes and tables at rest, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, chunking, ingest, rules, segment, store
from ..operators.commit_log import Store
from ..operators.grouped import GroupedIndex
from ..operators.inverted import SearchIndex
from ..operators.vector_index import VectorIndex
from ..session import table, work_folder
from ..sources import files, office
from . import search as plain


def _updated_index(spark: SparkSession, d: str) -> SearchIndex:
    """An index of all documents that has seen drafts of them, deletes and replacements."""
    docs = plain._docs(spark, d).where("doc_id is not null").select("doc_id", "text")
    index = SearchIndex.create(Store.create(spark, work_folder(spark)), buckets=8)
    index.update(docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" draft of the text")).alias("text")))
    half, some = F.col("doc_id") % 2 == 0, F.col("doc_id") % 7 == 0
    index.update(docs.where(half & ~some), docs.where(some))
    index.update(docs.where(~half | some))
    return index


def bm25_index_search(spark: SparkSession, d: str) -> DataFrame:
    return _updated_index(spark, d).search(plain._items(spark, d), 50)


def bm25_index_terms(spark: SparkSession, d: str) -> DataFrame:
    return _updated_index(spark, d).terms().select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_index_compact(spark: SparkSession, d: str) -> DataFrame:
    index = _updated_index(spark, d)
    index.compact()
    return index.search(plain._items(spark, d), 10)


def _vector_index(spark: SparkSession, d: str) -> VectorIndex:
    return VectorIndex.build(Store.create(spark, work_folder(spark)), plain._vectors(spark, d), "doc_id", "vector", cells=16, rounds=4)


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vector search by cells and codes: its rows may differ from dense_topk's."""
    return _vector_index(spark, d).search(plain._vector_questions(spark, d), 10).withColumnRenamed("key", "doc_id")


def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Does the index find nine tenths of the ten nearest rows, and visit fewer than all cells?"""
    index = _vector_index(spark, d)
    found = index.search(plain._vector_questions(spark, d), 10).select("query_id", F.col("key").alias("doc_id"), F.lit(1).alias("hit"))
    true = plain.dense_topk(spark, d).select("query_id", "doc_id")
    hits = true.join(found, ["query_id", "doc_id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), (F.sum("hit") >= 0.9 * F.count("*")).alias("found_most"))
    return hits.withColumn("fewer_cells", F.lit(index.probes < index.cells))


def rule_join(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each benchmark item: its last twenty characters or, failing that, its first three."""
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("rule_id"), F.coalesce("text", F.lit("")).alias("t"))
    rules_ = items.select("rule_id", F.lit("enabled").alias("status"), F.struct(F.array(F.right("t", F.lit(20)), F.left("t", F.lit(3))).alias("patterns")).alias("trigger"))
    found = rules.scan_join(plain._docs(spark, d), rules_, "doc_id")
    return found.select("doc_id", "rule_id", "pattern", F.col("pos").cast("long").alias("pos"), F.sha1("snippet").alias("snippet_sha1"))


def hierarchical_index(spark: SparkSession, d: str) -> DataFrame:
    """As hierarchical_search, over folders of sources."""
    docs = plain._docs(spark, d).where("text is not null").select("doc_id", "source", "text")
    summaries = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    groups = bm25.search(summaries, plain._items(spark, d), 3, key="source")
    index = GroupedIndex.build(Store.create(spark, work_folder(spark)), docs, "doc_id", "source", folders=8)
    return index.search(groups, plain._items(spark, d), 10)


def lattice_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, each with a run of Han that can be cut in several ways."""
    words = [("研究", 900), ("研究生", 60), ("生命", 300), ("命", 20), ("起源", 200), ("生", 50)]
    docs = plain._docs(spark, d).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" 研究生命起源")).alias("text"))
    found = segment.segmented(docs, spark.createDataFrame(words, "word string, freq int"))
    return found.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.sha1(F.array_join("toks", "|")).alias("tokens_sha1"))


def column_reading(spark: SparkSession, d: str) -> DataFrame:
    """A page of twelve lines for each document, in one to three columns."""
    n, c = F.col("line"), F.col("doc_id") % 3 + 1
    lines = plain._docs(spark, d).where("doc_id is not null").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("line"))
    x = F.when(c == 1, F.lit(50.0)).otherwise(50.0 + 200.0 * (n % c) + (n * 13 + F.col("doc_id")) % 7)
    found = office.column_order(lines.select("doc_id", F.lit(1).alias("page"), "line", x.cast("double").alias("x0")))
    return found.select("doc_id", "line", F.col("columns").cast("long").alias("n_columns"), F.col("column").cast("long").alias("col"), F.col("reading").cast("long").alias("reading"))


def _text_files(spark: SparkSession, d: str) -> str:
    """A folder with a file for each source: its texts, a line each, breaks within them as blanks."""
    path = work_folder(spark)
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]", " ")
    rows = plain._docs(spark, d).where("source is not null and doc_id is not null").select("source", "doc_id", line.alias("line"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "line").write.partitionBy("source").text(path)
    return path


def scanned_folder(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder with their identities and sizes."""
    found = files.scan_folder(spark, _text_files(spark, d), ["txt"])
    return found.select(F.regexp_extract("relpath", "source=([^/]*)/", 1).alias("source"), "content_hash", F.col("size").cast("long").alias("n_bytes"))


def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole files through the parser of their extension."""
    texts = files.whole_texts(spark, f"{_text_files(spark, d)}/*").select(F.col("path").alias("relpath"), F.col("path").alias("doc_id"), "text")
    blocks = files.by_extension(texts, {"txt": lambda t: files.paragraph_blocks(t, "doc_id")})
    return blocks.select(F.regexp_extract("doc_id", "source=([^/]*)/", 1).alias("source"), "type", F.sha1("content").alias("content_sha1"))


def newest_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts", "event_type")
    return store.newest(rows, 500, "ts", "event_id").select("event_id", "event_type")


def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = plain._docs(spark, d)
    return ingest.lookup(docs, (F.col("lang") == "en") & (F.col("n_chars") > 1000), "doc_id").select("doc_id", F.sha1("text").alias("text_sha1"))


def article_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Articles named by whole texts with planted ones, each once, in Arabic figures."""
    n = F.col("doc_id") % 90 + 10
    whole = F.concat(F.lit("依照第十二条、第"), n.cast("string"), F.lit("条。"), F.coalesce("text", F.lit("")), F.lit("另见第三百零五条和第12条"))
    rows = chunking.with_articles(plain._docs(spark, d).where("doc_id is not null").select("doc_id", whole.alias("t")), "t")
    return rows.select("doc_id", F.array_join("articles", ",").alias("articles"), "article_no")


QUERIES = {f.__name__: f for f in (bm25_index_search, bm25_index_terms, bm25_index_compact, vector_index_topk, vector_index_recall, rule_join, hierarchical_index, lattice_tokens, column_reading, scanned_folder, file_blocks, newest_rows, chunk_lookup, article_metadata)}
_FILES = "f AS (SELECT source, string_agg(regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') || chr(10), '' ORDER BY doc_id) t FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY source)"
SQL = {
    "bm25_index_search": plain.SQL["bm25_search"],
    "bm25_index_terms": plain.SQL["bm25_fit"],
    "bm25_index_compact": f"WITH {plain._ITEMS}, {plain._bm25('items')} {plain._top('sparse', 10)}",
    "vector_index_recall": f"SELECT count(*) n_queries, TRUE found_most, TRUE fewer_cells FROM embeddings WHERE vec_id % {plain.EVERY} = 0",
    "rule_join": """WITH p AS (SELECT item_id::VARCHAR rule_id, unnest([right(coalesce(text, ''), 20), left(coalesce(text, ''), 3)]) pattern, unnest([0, 1]) o FROM benchmark),
      h AS (SELECT doc_id, rule_id, text, pattern, instr(text, pattern) pos FROM documents, p WHERE pattern <> '' AND instr(text, pattern) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY o) = 1)
      SELECT doc_id, rule_id, pattern, pos, sha1(replace(substring(text, greatest(1, pos - 40), pos + 120 - greatest(1, pos - 40)), chr(10), ' ')) snippet_sha1 FROM h""",
    "hierarchical_index": plain.SQL["hierarchical_search"],
    "lattice_tokens": f"SELECT doc_id, len(t)::BIGINT n_tokens, sha1(array_to_string(t, '|')) tokens_sha1 FROM (SELECT doc_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '{plain.W}'), ['研究', '生命', '起源']) t FROM documents)",
    "column_reading": """WITH l AS (SELECT doc_id, unnest(range(12)) line FROM documents WHERE doc_id IS NOT NULL)
      SELECT doc_id, line, doc_id % 3 + 1 n_columns, line % (doc_id % 3 + 1) col, row_number() OVER (PARTITION BY doc_id ORDER BY line % (doc_id % 3 + 1), line) - 1 reading FROM l""",
    "scanned_folder": f"WITH {_FILES} SELECT source, sha256(t) content_hash, strlen(t) n_bytes FROM f",
    "file_blocks": f"WITH {_FILES} SELECT source, 'paragraph' AS type, sha1(t) content_sha1 FROM f",
    "newest_rows": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "chunk_lookup": "SELECT doc_id, sha1(text) text_sha1 FROM documents WHERE lang = 'en' AND n_chars > 1000 ORDER BY doc_id LIMIT 1",
    "article_metadata": """SELECT doc_id, CASE WHEN doc_id % 90 + 10 = 12 THEN '12,305' ELSE '12,' || (doc_id % 90 + 10) || ',305' END articles, '12' article_no FROM documents WHERE doc_id IS NOT NULL""",
}
