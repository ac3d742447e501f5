"""Structured Streaming forms of the engine's incremental work."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import redact, store
from ..operators.commit_log import Conflict, Store
from ..session import checkpointed, with_timestamp


def file_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """day, kind, n with a watermark; works on streams and tables alike."""
    events = with_timestamp(events, time)
    if events.isStreaming:
        events = events.withWatermark(time, late)
    counted = events.groupBy(F.window(time, "1 day"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), kind, "n")


def appended(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only sink (audit rows, messages): exactly once through the file sink's log."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def keyed_upsert(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], name: str = "rows") -> StreamingQuery:
    """Latest row of each key in table `name` of the store at path: every batch is reduced to its
    latest rows and merged into the buckets that it has keys of. A batch's number is committed with
    it, so that one that is run again changes nothing."""
    Store.ensure(df.sparkSession, path).add_keyed(name, df.schema, keys)

    def batch(rows: DataFrame, number: int) -> None:
        merge = lambda old, new: store.latest(old.unionByName(new), keys, order)
        Store(rows.sparkSession, path).commit({name: (store.latest(rows, keys, order), merge)}, txn=(checkpoint, number))

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(files: DataFrame, parse: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Uploaded files (a binaryFile stream) parsed and handed to `sink`, a batch at a time."""
    return files.writeStream.foreachBatch(lambda rows, n: sink(parse(rows), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def placeholders(originals: DataFrame, path: str, checkpoint: str, kind: str = "kind", original: str = "original") -> StreamingQuery:
    """Numbers that never change for a stream of (kind, original), in the store at path: table
    `placeholders` (kind, original, number) and `counters` (kind, last).

    Each batch looks its originals up in the buckets they fall into, numbers the new ones of a kind
    by their text after the kind's last number, and commits both tables with the batch's number. So
    no state grows in memory, a batch that is run again changes nothing, and whoever commits in
    between makes the batch look again: no number is given twice. Nulls are left out.
    """
    schema = originals.schema
    spark = originals.sparkSession
    numbers = spark.createDataFrame([], f"kind {schema[kind].dataType.simpleString()}, original {schema[original].dataType.simpleString()}, number long").schema
    counters = spark.createDataFrame([], f"kind {schema[kind].dataType.simpleString()}, last long").schema
    at = Store.ensure(spark, path)
    at.add_keyed("placeholders", numbers, ["kind", "original"])
    at.add_keyed("counters", counters, ["kind"], depth=0)

    def batch(rows: DataFrame, number: int) -> None:
        own = Store(rows.sparkSession, path)
        seen = checkpointed(rows.select(F.col(kind).alias("kind"), F.col(original).alias("original")).dropna().distinct())
        upsert = lambda keys: lambda old, new: store.upsert(old, new, keys)
        for _ in range(20):
            now = own.version().number
            fresh = seen.join(own.read_near("placeholders", seen, now), ["kind", "original"], "left_anti")
            last = own.read("counters", now)  # a row a kind
            made = redact.numbered(fresh, "original", "kind").join(F.broadcast(last), "kind", "left")
            made = checkpointed(made.select("kind", "original", (F.coalesce("last", F.lit(0)) + F.col("number")).alias("number")))
            merges = {"placeholders": (made, upsert(["kind", "original"])), "counters": (made.groupBy("kind").agg(F.max("number").alias("last")), upsert(["kind"]))}
            try:
                own.commit(merges, txn=(checkpoint, number), after=now)
                return
            except Conflict:
                continue
        raise Conflict(f"others keep committing at {path}")

    return originals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
