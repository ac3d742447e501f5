from pyspark.sql import functions as F

from corpusloom.operators.commit_log import Store
from corpusloom.streaming import jobs

SCHEMA = "id long, k string, v int, ts timestamp"


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "id long, k string, v int").withColumn("ts", F.timestamp_seconds("id")).coalesce(1).write.mode("append").parquet(folder)


def test_latest_by_key_over_two_runs(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    _write(spark, src, [(1, "a", 1), (2, "b", 2), (3, "a", 3)])
    run = lambda: jobs.keyed_upsert(jobs.file_stream(spark, src, SCHEMA), out, check, ["k"], ["ts", "id"]).awaitTermination()
    run()
    assert {r.k: r.v for r in Store(spark, out).read("rows").collect()} == {"a": 3, "b": 2}
    _write(spark, src, [(0, "a", 9), (5, "b", 5), (6, "c", 6)])
    run()
    assert {r.k: r.v for r in Store(spark, out).read("rows").collect()} == {"a": 3, "b": 5, "c": 6}


def test_append_and_daily_counts(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    _write(spark, src, [(1, "a", 1), (90_000, "a", 2), (90_001, "b", 2)])
    jobs.appended(jobs.file_stream(spark, src, SCHEMA), out, check).awaitTermination()
    rows = spark.read.schema(SCHEMA).parquet(out)
    assert sorted((str(r.day)[:10], r.k, r.n) for r in jobs.daily_counts(rows, "ts", "k").collect()) == [("1970-01-01", "a", 1), ("1970-01-02", "a", 1), ("1970-01-02", "b", 1)]
    q = jobs.daily_counts(jobs.file_stream(spark, src, SCHEMA), "ts", "k").writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").count() == 3


def test_placeholders(spark, tmp_path):
    src, check, path = f"file://{tmp_path}/in", f"file://{tmp_path}/check", f"file://{tmp_path}/numbers"
    schema = "kind string, original string"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: jobs.placeholders(jobs.file_stream(spark, src, schema), path, check).awaitTermination()
    seen = lambda: sorted((r.kind, r.original, r.number) for r in Store(spark, path).read("placeholders").collect())
    add(("phone", "2"), ("phone", "1"), ("card", "1"), ("phone", "1"), (None, "1"), ("card", None))
    run()
    first = [("card", "1", 1), ("phone", "1", 1), ("phone", "2", 2)]
    assert seen() == first
    add(("phone", "0"), ("phone", "2"), *[("name", f"n{i:03d}") for i in range(300)])
    run()  # a new query: a restart
    want = sorted([*first, ("phone", "0", 3), *[("name", f"n{i:03d}", i + 1) for i in range(300)]])
    assert seen() == want
    run()
    assert seen() == want


def test_placeholders_of_two_writers_are_numbered_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/numbers", "kind string, original string"
    queries = []
    for i in range(2):
        src = f"file://{tmp_path}/in{i}"
        spark.createDataFrame([("k", f"{i}-{j}") for j in range(20)] + [("k", f"both-{j}") for j in range(20)], schema).write.parquet(src)
        queries.append(jobs.placeholders(jobs.file_stream(spark, src, schema), path, f"file://{tmp_path}/check{i}"))
    for q in queries:
        q.awaitTermination()
    rows = Store(spark, path).read("placeholders").collect()
    assert len(rows) == 60 and sorted(r.number for r in rows) == list(range(1, 61))


def test_a_batch_of_placeholders_that_stops_is_run_again(spark, tmp_path, monkeypatch):
    src, check, path = f"file://{tmp_path}/in", f"file://{tmp_path}/check", f"file://{tmp_path}/numbers"
    spark.createDataFrame([("a", "x"), ("a", "y")], "kind string, original string").coalesce(1).write.parquet(src)
    run = lambda: jobs.placeholders(jobs.file_stream(spark, src, "kind string, original string"), path, check).awaitTermination()
    real = Store.commit
    with monkeypatch.context() as patch:
        def stops(self, *a, **b):
            real(self, *a, **b)  # the numbers are committed, but the stream doesn't learn of it
            raise RuntimeError("stopped")

        patch.setattr(Store, "commit", stops)
        try:
            run()
            raise AssertionError("should have stopped")
        except Exception as e:  # noqa: BLE001
            assert "stopped" in str(e)
    run()
    assert sorted((r.original, r.number) for r in Store(spark, path).read("placeholders").collect()) == [("x", 1), ("y", 2)]
