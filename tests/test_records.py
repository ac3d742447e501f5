import pytest
from pyspark.sql import functions as F

from corpusloom.operators import history, rules, store
from corpusloom.operators.filters import PUBLIC, compile_filter, parsed, scope


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "public", None, None, "民法典", ["1", "2"]), (2, None, None, None, "刑法", []), (3, "user", "local", "f1", "x", None), (4, "user", "local", "f2", "x", ["2"]), (5, "user", "other", "f1", "x", ["9"])]
    return spark.createDataFrame(rows, "id int, corpus string, user_id string, folder string, law_name string, articles array<string>")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(chunks):
    assert ids(chunks.where(compile_filter({"must": [{"key": "metadata.articles", "match": {"any": ["2", "7"]}}]}))) == [1, 4]
    assert ids(chunks.where(compile_filter({"should": [{"is_empty": {"key": "articles"}}, {"key": "law_name", "match": {"value": "民法典"}}]}))) == [1, 2, 3]
    assert ids(chunks.where(compile_filter({"must": [{"must": [{"key": "corpus", "match": {"any": ["user"]}}]}, {"key": "folder", "match": {"value": "f1"}}]}))) == [3, 5]
    assert ids(chunks.where(compile_filter(None))) == [1, 2, 3, 4, 5]
    assert ids(chunks.where(parsed("x", ["2"]))) == [4]


def test_scopes(chunks):
    assert ids(chunks.where(scope([]))) == [1, 2, 3, 4, 5]
    assert ids(chunks.where(scope([PUBLIC]))) == [1, 2]
    assert ids(chunks.where(scope(["f1"]))) == [3]
    assert ids(chunks.where(scope([PUBLIC, "f2"]))) == [1, 2, 4]
    assert ids(chunks.where(scope(None, ["f1", "f2"]))) == [3, 4]
    assert ids(chunks.where(scope(None, None, "user"))) == [3, 4]
    assert ids(chunks.where(scope(None, None, "public"))) == [1, 2]


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    assert ids(store.delete_where(df, F.col("k") == "a")) == [2]


def test_pages(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, k string")
    first = store.page(df, ["k", "id"], None, 4).collect()
    second = store.page(df, ["k", "id"], [first[-1].k, first[-1].id], 4).collect()
    assert [r.id for r in (*first, *second)] == [0, 2, 4, 6, 8, 1, 3, 5]


def test_history(spark):
    rows = spark.createDataFrame([("s", i, "user" if i % 2 else "assistant", "x" * 20) for i in range(21)], "s string, id int, role string, text string")
    last = history.last_messages(rows, "s", "id").orderBy("place").collect()
    assert [r.id for r in last] == list(range(1, 21))
    assert history.compressed(rows, "s", "id", "role", "text").count() == 21
    short = history.compressed(rows, "s", "id", "role", "text", max_tokens=100).orderBy("place").collect()
    assert len(short) == 6 and short[0].role == "system" and "16" in short[0].text and len(short[0].text) < 2050


def test_a_summary_may_end_with_the_break_before_a_line(spark):
    texts = ["a" * 7, "b" * 7, "c" * 7, "d" * 7, "e"]
    rows = spark.createDataFrame([("s", i, "r", t) for i, t in enumerate(texts)], "s string, id int, role string, text string")
    said = "\n".join(f"r: {t}" for t in texts[:-1])
    for most in range(1, len(said) + 3):  # 11 characters a line with its break
        got = history.compressed(rows, "s", "id", "role", "text", max_tokens=1, keep=1, most=most).orderBy("place").first().text
        assert got == f"[历史摘要] 更早 4 条消息已压缩：{said[:most]}..."


def test_highlights(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 5, 7), (1, 9, 10), (2, 1, 2)], "d int, start int, end int")
    assert sorted(tuple(r) for r in history.merged_ranges(df, ["d"]).collect()) == [(1, 0, 7), (1, 9, 10), (2, 1, 2)]


@pytest.fixture(scope="module")
def rule_rows(spark):
    rows = [("r1", "d", (["无此", "违约金"],), "high", "过高", "调整", [("民法典", "585")], "builtin", "enabled"), ("r2", "d", (["管辖"],), "low", "管辖不明", "写明", [], "builtin", None), ("r3", "d", (["违约金"],), "low", "x", "x", [], "b", "disabled"), ("r4", "d", None, "low", "x", "x", [], "b", "enabled")]
    return spark.createDataFrame(rows, "rule_id string, dimension string, trigger struct<patterns:array<string>>, risk_level string, risk_desc string, suggestion_template string, basis array<struct<law:string,article:string>>, source string, status string")


def test_rules(spark, rule_rows):
    docs = spark.createDataFrame([(1, "甲\n乙方支付违约金百分之五十。\n争议由法院管辖。"), (2, None), (3, "无")], "doc_id long, text string")
    hits = rules.scan(docs, rule_rows, "doc_id")
    assert sorted((r.doc_id, r.rule_id, r.pattern, r.pos) for r in hits.collect()) == [(1, "r1", "违约金", 7), (1, "r2", "管辖", 22)]
    risks = rules.with_rules(hits, rule_rows)
    got = rules.annotated(docs, risks, "doc_id").orderBy("doc_id").collect()
    assert "> **风险提示** [high] 过高 → 调整" in got[0].annotated and got[1].annotated == ""
    # a snippet over several lines is found in none of them as a whole
    risks_one = risks.withColumn("snippet", F.when(F.col("rule_id") == "r1", "支付违约金").otherwise("不在文中的片段"))
    row = rules.annotated(docs.where("doc_id = 1"), risks_one, "doc_id").first()
    assert (row.n_placed, row.n_unplaced) == (1, 1) and row.annotated.split("\n")[2].startswith("> **风险提示** [high]") and row.annotated.endswith("> 相关片段：不在文中的片段")
    report = rules.report(risks, ["doc_id"], "doc_id").first().report
    assert "风险总数：2（高 1 / 中 0 / 低 1）" in report


def test_rule_edge_sets(spark, rule_rows):
    docs = spark.createDataFrame([(1, "违约金")], "doc_id long, text string")
    assert rules.scan(docs, rule_rows.limit(0), "doc_id").count() == 0


def test_version_class(spark):
    names = ["合同.docx", "合同_脱敏.md", "合同_批注版.docx", "审查报告.md"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.v for r in df.select(rules.version_class(F.col("n")).alias("v")).collect()] == ["original", "redacted", "annotated", "report"]
