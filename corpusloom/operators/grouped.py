"""Search inside chosen groups: documents lie in folders by their group, and a search opens the
folders of the groups that its questions have chosen. Statistics are those of all documents, kept
aside when the index is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpointed
from . import bm25
from .commit_log import Store
from .inverted import term_counts

FOLDERS = 64
FILE_ROWS = 1 << 18
FEW = 1_000_000


class GroupedIndex:
    def __init__(self, at: Store, key: str, group: str, name: str = "grouped") -> None:
        self.store, self.key, self.group, self.name = at, key, group, name

    @classmethod
    def build(cls, at: Store, docs: DataFrame, key: str, group: str, text: str = "text", folders: int = FOLDERS, name: str = "grouped") -> GroupedIndex:
        """Documents (key, group, text); those without a group have a folder like any other group's."""
        spark = docs.sparkSession
        counted = checkpointed(term_counts(docs.select(F.struct(key, group).alias("_k"), text), "_k", text).select(f"_k.{key}", f"_k.{group}", "dl", "terms", "tfs"))
        rows = counted.withColumn("folder", F.pmod(F.xxhash64(group), F.lit(folders)).cast("int"))
        # a group of very many documents has several files
        files = max(1, -(-rows.count() // (folders * FILE_ROWS)))
        terms = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        stats = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        at.add_appended(f"{name}_rows", rows.schema, ["folder"])
        at.add_appended(f"{name}_terms", terms.schema)
        at.add_appended(f"{name}_stats", stats.schema)
        at.add_appended(f"{name}_meta", spark.createDataFrame([], "folders int").schema)
        dealt = rows.repartition("folder", F.pmod(F.xxhash64(key), F.lit(files))).sortWithinPartitions("folder", group, key)
        meta = spark.range(1).select(F.lit(folders).alias("folders"))
        at.commit(replaces={f"{name}_rows": dealt, f"{name}_terms": terms, f"{name}_stats": stats, f"{name}_meta": meta})
        return cls(at, key, group, name)

    def _read(self, what: str) -> DataFrame:
        return self.store.read(f"{self.name}_{what}")

    def chosen(self, groups: DataFrame) -> DataFrame:
        """The rows of the folders that the groups lie in; folders, not rows, pass the driver."""
        folders = self._read("meta").first()[0]
        asked = sorted(r[0] for r in groups.select(F.pmod(F.xxhash64(self.group), F.lit(folders)).cast("int").alias("f")).distinct().collect())
        return self._read("rows").where(F.col("folder").isin(asked))

    def search(self, groups: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query_id, key, score, rank: the k best documents of each question (query_id, text) within the
        groups (query_id, group) chosen for it."""
        key, group = self.key, self.group
        groups = checkpointed(groups.select("query_id", group).distinct())
        asked = bm25.query_terms(queries, "query_id", "text")
        few = broadcast_if_small(asked.select("term").distinct(), bm25.MAX_QUERY_ROWS)
        df = self._read("terms").join(few, "term", "left_semi").crossJoin(F.broadcast(self._read("stats")))
        idf = bm25.idf(F.col("df"), F.col("n_docs"))
        weighted = asked.join(df, "term").select("query_id", "term", "avgdl", idf.alias("idf"), bm25.query_weight(idf, F.col("qtf")).alias("wq"))
        each = self.chosen(groups).join(broadcast_if_small(groups.select(group).distinct(), FEW), group, "left_semi")
        each = each.select(key, group, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(key, group, "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
        pairs = groups.join(weighted, "query_id")
        w = bm25.document_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
        found = each.join(broadcast_if_small(pairs, FEW), [group, "term"]).groupBy("query_id", key).agg(F.sum(F.col("wq") * w).alias("score"))
        return bm25.ranked(found, k, "query_id", key)
