"""Queries on conversations, events and keyed tables; streams over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters, history, redact, store
from ..operators.commit_log import Store
from ..operators.rules import version_class
from ..session import table, with_timestamp, work_folder
from ..streaming import jobs


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return with_timestamp(table(spark, d, "events"), "ts")


def history_last_n(spark, d):
    rows = history.last_messages(_turns(spark, d), "conv_id", "turn", 3, F.col("role").isin("user", "assistant"))
    return rows.select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


def history_compress(spark, d):
    rows = history.compressed(_turns(spark, d), "conv_id", "turn", "role", "text", max_tokens=150, keep=2, each=80, most=300)
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), "role", F.sha1("text").alias("text_sha1"))


def agent_compress(spark, d):
    rows = history.agent_compressed(_turns(spark, d), "conv_id", "turn", "role", "text", first=1, last=1, summed=2, each=50)
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), "role", F.sha1("text").alias("text_sha1"))


def token_totals(spark, d):
    return history.token_totals(_turns(spark, d), "conv_id", "text")


def feedback_summary(spark, d):
    rows = _events(spark, d).select("event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("status"))
    return history.feedback_summary(rows, "event_type", "status")


def kb_overview(spark, d):
    return history.overview(table(spark, d, "documents"), "source", "n_chars")


def version_classes(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").groupBy(version_class(F.concat(name, F.when(F.col("p_size") % 3 == 0, "_redacted").when(F.col("p_size") % 3 == 1, "_Report").otherwise(""))).alias("version")).agg(F.count("*").alias("n"))


def trace_latest(spark, d):
    rows = history.latest_traces(_events(spark, d).withColumn("event_type", F.col("event_type")), "user_id", "event_type", "props", ["ts", "event_id"], most=40)
    return rows.select("user_id", F.explode("traces").alias("event_type", "trace"))


def classifier_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    told = F.coalesce(F.col("text").rlike("[#$%&*]{3}|!!"), F.lit(False))
    return history.classifier_metrics(rows, F.col("quality") == 0, told)


def upsert_latest(spark, d):
    """Latest event of each user and type, then the users' rows replaced by those of the orders' day."""
    rows = _events(spark, d).select("user_id", "event_type", "ts", "event_id", "value")
    return store.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


def keyed_upsert(spark, d):
    rows = _customers(spark, d)
    new = rows.where(F.col("c_custkey") % 4 == 0).select((F.col("c_custkey") + F.when(F.col("c_custkey") % 8 == 0, 10_000_000).otherwise(0)).alias("c_custkey"), F.upper("c_name").alias("c_name"), "c_mktsegment", (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return store.upsert(rows, new, ["c_custkey"])


def insert_ignore(spark, d):
    rows = _customers(spark, d)
    new = rows.where(F.col("c_custkey") % 4 == 0).select((F.col("c_custkey") + F.when(F.col("c_custkey") % 8 == 0, 10_000_000).otherwise(0)).alias("c_custkey"), F.upper("c_name").alias("c_name"), "c_mktsegment", "c_acctbal")
    return store.insert_missing(rows, new, ["c_custkey"])


def patch_update(spark, d):
    rows = _customers(spark, d)
    patch = rows.where(F.col("c_custkey") % 3 == 0).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("PATCHED")).alias("c_mktsegment"))
    return store.patched(rows, patch, ["c_custkey"])


def delete_by_key(spark, d):
    rows = _customers(spark, d)
    return store.delete(rows, rows.where(F.col("c_acctbal") < 0), ["c_custkey"])


def delete_where(spark, d):
    return store.delete_where(_customers(spark, d), F.col("c_mktsegment") == "BUILDING")


def cascade_delete(spark, d):
    """Orders and their lines without the orders that are gone: lines left of each order."""
    orders, lines = table(spark, d, "orders").withColumnRenamed("o_orderkey", "key"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key")
    left = store.cascade(orders, [lines], orders.where(F.col("o_orderstatus") == "F").select("key"), ["key"])
    return left[1].groupBy("key").agg(F.count("*").alias("n_lines")).join(left[0].select("key", "o_orderstatus"), "key")


def scope_filter(spark, d):
    """Documents in view of a mixed scope: the public ones or own ones in two folders."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "public").when(F.col("lang") != "fr", "user").alias("corpus"), F.lit("local").alias("user_id"), F.col("source").alias("folder"))
    return rows.where(filters.scope([filters.PUBLIC, "src1", "src2"])).select("doc_id", "corpus", "folder")


def library_names(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).union(table(spark, d, "nation").select("n_name"))
    return names.distinct()


def encrypted_map(spark, d):
    """Names encrypted and decrypted again; the cipher text has a nonce and a tag besides."""
    key = "0123456789abcdef"
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("original"))
    hidden = redact.encrypted(rows, key).withColumn("cipher_bytes", F.octet_length(F.unbase64("original")).cast("long"))
    return redact.decrypted(hidden, key)


def day_counts(spark, d):
    return jobs.daily_counts(_events(spark, d), "ts", "event_type").select(F.col("day").cast("date").alias("day"), "event_type", "n")


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    # the folder holds other tables too
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _once(df: DataFrame, how: str) -> DataFrame:
    """Run a stream over what is there and give what came out."""
    out, checkpoint = work_folder(df.sparkSession), work_folder(df.sparkSession)
    jobs.appended(df, out, checkpoint).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def stream_append(spark, d):
    """Events through an append-only sink, then counted."""
    out = _once(_stream(spark, d).select("event_id", "event_type"), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


def stream_latest(spark, d):
    """Latest event of each user by a stream of keyed upserts."""
    path, checkpoint = work_folder(spark), work_folder(spark)
    rows = with_timestamp(_stream(spark, d), "ts").select("user_id", "ts", "event_id", "event_type")
    jobs.keyed_upsert(rows, path, checkpoint, ["user_id"], ["ts", "event_id"]).awaitTermination()
    return Store(spark, path).read("rows").select("user_id", "event_id", "event_type")


def message_gaps(spark, d):
    """Time between a user's events, as the audit log is read."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    return _events(spark, d).withColumn("gap", gap).groupBy("user_id").agg(F.count("*").alias("n"), F.max("gap").alias("longest_us"))


QUERIES = {
    f.__name__: f
    for f in (
        history_last_n, history_compress, agent_compress, token_totals, feedback_summary, kb_overview, version_classes, trace_latest, classifier_metrics, upsert_latest, keyed_upsert, insert_ignore, patch_update,
        delete_by_key, delete_where, cascade_delete, scope_filter, library_names, encrypted_map, day_counts, stream_append, stream_latest, message_gaps,
    )
}

_TOKENS = "greatest(1, length(coalesce(text, '')) // 2)"
_NEW = "SELECT c_custkey + CASE WHEN c_custkey % 8 = 0 THEN 10000000 ELSE 0 END c_custkey, upper(c_name) c_name, c_mktsegment, {bal} c_acctbal FROM customer WHERE c_custkey % 4 = 0"

SQL = {
    "history_last_n": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) b FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) place FROM k WHERE b <= 3",
    "history_compress": f"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) b, sum({_TOKENS}) OVER (PARTITION BY conv_id) t FROM conversations),
      s AS (SELECT conv_id, NULL::BIGINT turn, 'system' AS role, '[历史摘要] 更早 ' || count(*) || ' 条消息已压缩：' || substring(string_agg(role || ': ' || substring(text, 1, 80), chr(10) ORDER BY turn), 1, 300) || '...' text FROM r WHERE t > 150 AND b > 2 GROUP BY conv_id),
      a AS (SELECT * FROM s UNION ALL SELECT conv_id, turn, role, text FROM r WHERE t <= 150 OR b <= 2) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) place, role, sha1(text) text_sha1 FROM a""",
    "agent_compress": """WITH r AS (SELECT conv_id, role, coalesce(text, '') text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) b FROM conversations),
      s AS (SELECT conv_id, min(n) n, 'system' AS role, string_agg(role || ': ' || substring(text, 1, 50), chr(10) ORDER BY n) text FROM r WHERE n > 1 AND b > 1 AND b <= 3 GROUP BY conv_id),
      a AS (SELECT conv_id, n, role, text FROM r WHERE n <= 1 OR b <= 1 UNION ALL SELECT * FROM s) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) place, role, sha1(text) text_sha1 FROM a""",
    "token_totals": f"SELECT conv_id, sum({_TOKENS})::BIGINT tokens FROM conversations GROUP BY conv_id",
    "feedback_summary": "WITH r AS (SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END status FROM events) SELECT event_type, status, count(*) n FROM r GROUP BY GROUPING SETS ((event_type, status), ())",
    "kb_overview": "SELECT source, count(*) n_docs, coalesce(sum(n_chars), 0)::BIGINT n_chunks FROM documents GROUP BY source",
    "version_classes": "SELECT CASE p_size % 3 WHEN 0 THEN 'redacted' WHEN 1 THEN 'report' ELSE 'original' END AS version, count(*) n FROM part GROUP BY 1",
    "trace_latest": "SELECT user_id, event_type, substring(arg_max(props, {'t': ts, 'e': event_id}), 1, 40) trace FROM events GROUP BY user_id, event_type",
    "classifier_metrics": r"""WITH r AS (SELECT quality = 0 truth, coalesce(regexp_matches(text, '[#$%&*]{3}|!!'), false) told FROM labels JOIN documents USING (doc_id)),
      c AS (SELECT count(*) n, count(*) FILTER (truth AND told) tp, count(*) FILTER (NOT truth AND told) fp, count(*) FILTER (truth AND NOT told) fn, count(*) FILTER (NOT truth AND NOT told) tn FROM r)
      SELECT *, round((tp + tn) / n, 6) accuracy, round(fp / (fp + tn), 6) false_block_rate, round(tp / (tp + fn), 6) block_rate FROM c""",
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "keyed_upsert": f"WITH n AS ({_NEW.format(bal='c_acctbal * 2')}) SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n",
    "insert_ignore": f"WITH n AS ({_NEW.format(bal='c_acctbal')}) SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)",
    "patch_update": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'PATCHED' ELSE c_mktsegment END c_mktsegment, c_acctbal FROM customer",
    "delete_by_key": "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal >= 0",
    "delete_where": "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL",
    "cascade_delete": "SELECT o_orderkey AS key, count(*) n_lines, any_value(o_orderstatus) o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY o_orderkey",
    "scope_filter": "WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'public' WHEN lang <> 'fr' THEN 'user' END corpus, source folder FROM documents) SELECT * FROM r WHERE corpus = 'public' OR corpus IS NULL OR (corpus = 'user' AND folder IN ('src1', 'src2'))",
    "library_names": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
    "encrypted_map": "SELECT s_suppkey, s_name original, strlen(s_name) + 28 cipher_bytes FROM supplier",
    "day_counts": "SELECT ts::DATE AS day, event_type, count(*) n FROM events GROUP BY ALL",
    "stream_append": "SELECT event_type, count(*) n, count(DISTINCT event_id) n_ids FROM events GROUP BY event_type",
    "stream_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "message_gaps": "WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) gap FROM events) SELECT user_id, count(*) n, max(gap) longest_us FROM g GROUP BY user_id",
}
