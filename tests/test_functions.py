import pytest
from pyspark.sql import functions as F

from corpusloom.functions import citations, query, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("cn", "n"), [("一", 1), ("十", 10), ("十二", 12), ("一百二十", 120), ("一千零七十九", 1079), ("二百零五", 205), ("万", 0), ("", 0), ("两千", 2000)])
def test_numerals(spark, cn, n):
    assert one(spark, cn, text.chinese_to_arabic) == n
    if n and cn not in ("两千",):
        back = spark.createDataFrame([(n,)], "n int").select(text.arabic_to_chinese(F.col("n")).alias("x")).first().x
        assert back == cn


def test_numerals_round_trip(spark):
    rows = spark.range(0, 10000).select("id", text.arabic_to_chinese(F.col("id").cast("int")).alias("cn"))
    assert rows.where(text.chinese_to_arabic(F.col("cn")) != F.col("id")).count() == 0
    assert rows.select("cn").distinct().count() == 10000


def test_tokens(spark):
    assert one(spark, "Héllo, wörld_1 ß 民法典", text.tokens) == ["héllo", "wörld_1", "ß", "民法典"]
    assert one(spark, None, text.tokens) == []
    assert one(spark, "劳动合同法第10条 ok", lambda c: text.lexicon_tokens(c, ["劳动", "劳动合同", "法"])) == ["劳动合同", "法", "第", "10", "条", "ok"]


def test_ids_and_estimates(spark):
    import hashlib

    assert one(spark, "abc", text.document_id) == "sha256:" + hashlib.sha256(b"abc").hexdigest()
    assert one(spark, "d", lambda c: text.chunk_id(c, F.lit(3))) == "chunk:" + hashlib.sha256(b"d:3").hexdigest()[:16]
    assert one(spark, "abc", text.content_chunk_id) == "chunk:" + hashlib.sha1(b"abc").hexdigest()[:16]
    assert one(spark, "abc", lambda c: text.embedding_key("m", c)) == hashlib.sha256(b"m:abc").hexdigest()
    assert [one(spark, t, text.token_estimate) for t in (None, "", "a", "abcd", "abcde")] == [1, 1, 1, 2, 2]
    assert one(spark, "x" * 50 + "KEY\n" + "y" * 200, lambda c: text.snippet(c, F.instr(c, "KEY"))) == "x" * 40 + "KEY " + "y" * 116
    assert one(spark, "a\nnot advice\nb", lambda c: text.strip_disclaimer(c, ["not advice"])) == "a\nb"


@pytest.mark.parametrize(
    ("q", "reason"),
    [("", "trivial"), (" ", "trivial"), ("a", "trivial"), ("？？!_", "trivial"), ("你好", "trivial"), ("Hello", "trivial"), ("今天天气怎么样", "trivial"), ("好看吗", "short_non_legal"), ("民法典第32条", None), ("这个问题应该怎么办呢", None), (None, "trivial")],
)
def test_prefilter(spark, q, reason):
    assert one(spark, q, query.blocked_reason) == reason


@pytest.mark.parametrize(
    ("q", "law", "articles", "excluded"),
    [
        ("民法典第32条", "中华人民共和国民法典", ["32"], []),
        ("刑法第二百六十四条", "中华人民共和国刑法", ["264"], []),
        ("第一千零七十九条", None, ["1079"], []),
        ("除了第三条以外，第五条", None, ["5"], ["3"]),
        ("劳动合同法第十条和第十一条", "中华人民共和国劳动合同法", ["10", "11"], []),
        ("合同纠纷怎么办", None, [], []),
    ],
)
def test_parse(spark, q, law, articles, excluded):
    row = query.parse(spark.createDataFrame([(q,)], "query string")).first()
    assert (row.law_name, row.articles, row.excluded, row.exact_match) == (law, articles, excluded, bool(articles))


def test_effect_level_and_difficulty(spark):
    assert one(spark, "国务院的行政法规", query.effect_level) == "行政法规"
    level = lambda q, exact=False: tuple(one(spark, q, lambda c: query.difficulty(c, F.lit(exact))))
    assert level("x", True) == ("simple", "exact_match", 5)
    assert level("两者的区别") == ("hard", "compare_words", 10)
    assert level("吗？吗?") == level("长" * 41) == ("hard", "multi_question_or_long", 10)
    assert level("举证责任") == ("medium", "procedure_words", 8)
    assert level("长" * 40) == ("medium", "default", 8)


def test_citations(spark):
    docs = spark.createDataFrame([(1, "依据《民法典》第32条和刑法第二百六十四条，又民法典第三十二条；根据某某管理办法第五条。")], "id int, text string")
    found = citations.extract(docs, "id", "text")
    got = {(r.law_name, r.article_no) for r in found.collect()}
    assert got == {("中华人民共和国民法典", "32"), ("中华人民共和国刑法", "264"), ("某某管理办法", "5")}
    chunks = spark.createDataFrame([("中华人民共和国民法典", ["31", "32"]), ("中华人民共和国刑法", ["1"])], "law_name string, articles array<string>")
    status = {r.law_name: r.status for r in citations.verify(found, chunks).collect()}
    assert status == {"中华人民共和国民法典": "verified", "中华人民共和国刑法": "unverifiable", "某某管理办法": "unverifiable"}


def test_locate(spark):
    body = "前言" + "甲" * 40 + "第五百八十条 违约责任。第五百八十一条 其他"
    get = lambda n: one(spark, body, lambda c: citations.locate(c, F.lit(n)))
    assert get("580") == "甲" * 30 + "第五百八十条 违约责任。"
    assert get("7") is None
