"""Conversations, traces and operational summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .store import latest


def last_messages(messages: DataFrame, session: str, order: str, n: int = 20, where: Column | None = None) -> DataFrame:
    """The newest n messages of each session that pass, with their place (from 1, oldest first)."""
    some = messages.where(where) if where is not None else messages
    back = Window.partitionBy(session).orderBy(F.desc(order))
    kept = some.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_back")))).drop("_back")


def token_totals(messages: DataFrame, session: str, text: str) -> DataFrame:
    return messages.groupBy(session).agg(F.sum(token_estimate(F.col(text))).cast("long").alias("tokens"))


def compressed(messages: DataFrame, session: str, order: str, role: str, text: str, max_tokens: int = 128_000, keep: int = 5, each: int = 500, most: int = 2000) -> DataFrame:
    """session, place, role, text: sessions above the limit get one system message that sums up all
    but the newest `keep`, then these; others stay."""
    back = Window.partitionBy(session).orderBy(F.desc(order))
    rows = messages.select(session, F.col(order).alias("_o"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_back", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_o"))))
    rows = rows.withColumn("_total", F.sum(token_estimate(F.col("text"))).over(Window.partitionBy(session)))
    over = F.col("_total") > max_tokens
    new = rows.where(~over | (F.col("_back") <= keep)).select(session, "_o", "role", "text")
    # of the older ones no more is used than fills the summary: the break before a line may be its last character
    old = rows.where(over & (F.col("_back") > keep))
    line = F.concat("role", F.lit(": "), F.substring("text", 1, each))
    ahead = Window.partitionBy(session).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    old = old.withColumn("_line", line).withColumn("_used", F.coalesce(F.sum(F.length("_line") + 1).over(ahead), F.lit(0)))
    some = old.groupBy(session).agg(F.array_sort(F.collect_list(F.when(F.col("_used") <= most, F.struct("_o", "_line")))).alias("x"), F.count("*").alias("n"))
    body = F.substring(F.array_join(F.transform("x", lambda v: v["_line"]), "\n"), 1, most)
    summary = some.select(session, F.lit(None).cast(rows.schema["_o"].dataType).alias("_o"), F.lit("system").alias("role"), F.concat(F.lit("[历史摘要] 更早 "), F.col("n").cast("string"), F.lit(" 条消息已压缩："), body, F.lit("...")).alias("text"))
    w = Window.partitionBy(session).orderBy(F.asc_nulls_first("_o"))
    return summary.unionByName(new).withColumn("place", F.row_number().over(w)).select(session, "place", "role", "text")


def agent_compressed(messages: DataFrame, session: str, order: str, role: str, text: str, first: int = 2, last: int = 4, summed: int = 6, each: int = 200) -> DataFrame:
    """The first 2 and last 4 messages; between them one summary of the last 6 of the others."""
    w, back = Window.partitionBy(session).orderBy(order), Window.partitionBy(session).orderBy(F.desc(order))
    rows = messages.select(session, order, F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_back", F.row_number().over(back))
    kept = (F.col("_n") <= first) | (F.col("_back") <= last)
    middle = rows.where(~kept & (F.col("_back") <= last + summed))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat("role", F.lit(": "), F.substring("text", 1, each)).alias("t")))), lambda x: x["t"]), "\n")
    summary = middle.groupBy(session).agg(F.min("_n").alias("_n"), said.alias("text")).withColumn("role", F.lit("system"))
    out = rows.where(kept).select(session, "_n", "role", "text").unionByName(summary.select(session, "_n", "role", "text"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy("_n"))).drop("_n")


def latest_traces(traces: DataFrame, session: str, kind: str, trace: str, order: Sequence[str], most: int = 200_000) -> DataFrame:
    """session, traces: of each kind the latest trace (cut to `most` characters), as a map."""
    last = latest(traces.select(session, kind, trace, *[c for c in order if c not in (session, kind, trace)]), [session, kind], order)
    entry = F.struct(F.col(kind).alias("key"), F.substring(trace, 1, most).alias("value"))
    return last.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("traces"))


def feedback_summary(rows: DataFrame, reason: str, status: str) -> DataFrame:
    """reason, status, n for each pair, and the grand total as a row without either."""
    return rows.groupBy(reason, status).agg(F.count("*").alias("n")).unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias(reason), F.lit(None).cast("string").alias(status), "n"))


def overview(rows: DataFrame, folder: str, count: str) -> DataFrame:
    """folder, n_docs, n_chunks."""
    return rows.groupBy(folder).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(count), F.lit(0)).alias("n_chunks"))


def merged_ranges(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: overlapping or touching ranges as one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def classifier_metrics(rows: DataFrame, truth: Column, told: Column) -> DataFrame:
    """One row: counts of a two-way classifier, accuracy, false-block and block rates."""
    one = rows.agg(F.count("*").alias("n"), F.count_if(truth & told).alias("tp"), F.count_if(~truth & told).alias("fp"), F.count_if(truth & ~told).alias("fn"), F.count_if(~truth & ~told).alias("tn"))
    rate = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return one.select("*", rate(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_block_rate"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("block_rate"))
