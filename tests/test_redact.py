import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators.redact import LAST_LAYERS
from corpusloom.operators import redact as r

TEXT = "原告：张三，与李四签订合同。北京星河科技有限公司 电话13800138000 邮箱 a.b@x.com 证 110101199003071234 王某某"


def test_scan():
    found = r.scan(TEXT)
    assert ("person_name", "张三") in [s[:2] for s in found] and ("company_name", "北京星河科技有限公司") in [s[:2] for s in found]
    assert ("id_card", "110101199003071234") in [s[:2] for s in found]  # also a credit code by form
    assert not any(s[0] == "phone" and s[1] != "13800138000" for s in found)
    assert all(TEXT[a:b] == v for _, v, a, b in found)
    assert r.scan(None) == [] and r.scan(TEXT, ["phone"]) == [("phone", "13800138000", TEXT.index("138"), TEXT.index("138") + 11)]
    assert r.scan("统一社会信用代码") == []


def test_overlaps(spark):
    spans = [("x", "a", 0, 6), ("x", "b", 5, 8), ("x", "c", 8, 9)]
    assert [s[2:] for s in r.resolve(spans)] == [(0, 6), (8, 9)]
    df = spark.createDataFrame([([(0, 6), (5, 8), (8, 9), (8, 12)],), ([],)], "s array<struct<start:int,end:int>>")
    assert [[tuple(x) for x in row.x] for row in df.select(r.resolve_spans(F.col("s")).alias("x")).collect()] == [[(0, 6), (8, 12)], []]


@pytest.mark.parametrize(("value", "category", "want"), [("ab@x.org", "email", "a*@x.org"), ("a@x.org", "email", "a*@x.org"), ("abcdefghijkl@x", "email", "a******l@x"), ("张", "", "*"), ("张三", "", "张*"), ("13800138000", "phone", "1******0"), ("张三丰", "", "张*丰"), ("", "", "")])
def test_middle_mask(spark, value, category, want):
    assert spark.range(1).select(r.middle_mask(F.lit(value), F.lit(category)).alias("x")).first().x == want


@pytest.mark.parametrize("method", ["placeholder", "mask", "hash"])
def test_mask_and_mapping(spark, method):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    made = r.mask_documents(docs.join(r.scan_documents(docs), "doc_id"), method=method)
    rows = made.withColumn("back", r.restore(F.col("masked"), F.col("entries"))).orderBy("doc_id").collect()
    masked, entries = rows[0].masked, rows[0].entries
    assert "13800138000" not in masked and len(entries) == len(r.scan(TEXT)) and rows[1].masked == ""
    assert (rows[0].back == TEXT) == (method != "hash")
    shown = masked
    for e in reversed(entries):  # the mapping is in the order from the end: each value once, in its place
        assert TEXT[e.start : e.end] == e.original and e.masked_value in shown
        shown = shown[shown.index(e.masked_value) + len(e.masked_value) :]
    if method == "placeholder":
        assert masked == r.mask(TEXT, r.scan(TEXT))[0]


def test_last_occurrence_is_number_one_and_stale_places():
    masked, entries = r.mask("a@b.c x a@b.c", [("email", "a@b.c", 0, 5), ("email", "a@b.c", 8, 13)])
    assert masked == "{{EMAIL_2}} x {{EMAIL_1}}"
    masked, entries = r.mask("zz a@b.c", [("email", "a@b.c", 0, 5), ("phone", "1", 90, 91)])
    assert masked == "zz {{EMAIL_1}}" and len(entries) == 1


@settings(max_examples=200, deadline=None)
@given(st.text("ab@.c13800138000 张三李四有限公司原告：", max_size=80))
def test_placeholders_restore(text):
    masked, entries = r.mask(text, r.scan(text))
    for e in sorted(entries, key=lambda e: -len(e["masked_value"])):
        masked = masked.replace(e["masked_value"], e["original"])
    assert masked == text


def test_reversible_map(spark):
    docs = spark.createDataFrame([(2, "电话13800138000 卡6222020200112233 证110101199003071234"), (1, "北京星河有限公司 13900139000 13800138000")], "doc_id long, text string")
    first = {x.original: x.placeholder for x in r.reversible_map(docs).collect()}
    assert first == {"13900139000": "[phone1]", "13800138000": "[phone2]", "6222020200112233": "[bankcard1]", "110101199003071234": "[idcard1]", "北京星河有限公司": "[company1]"}
    known = spark.createDataFrame([("phone", "13800138000", "[phone7]")], "kind string, original string, placeholder string")
    again = {x.original: x.placeholder for x in r.reversible_map(docs, known=known).collect()}
    assert again["13800138000"] == "[phone7]" and again["13900139000"] == "[phone8]"


def test_layers(spark):
    text = "依照第十条第二款，第三人：张三 支付1,000元/月 100万元 利率5% 2020年1月2日 账号 1234567890123456 见(2020)京01民初12号  完"
    masked, mapping = r.layered_mask(text)
    for hidden in ("张三", "1,000元", "100万元", "5%", "2020年1月2日", "1234567890123456", "民初12号"):
        assert hidden not in masked
    assert "依照第十条第二款" in masked and "第三人：{{PARTY_甲方}}" in masked and mapping["{{PARTY_甲方}}"] == "张三" and "  " not in masked
    row = r.layered_documents(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].masked == masked and row[1].masked == "" and row[0].n_entities >= 6


def test_places_and_institutions():
    masked, mapping = r.layered_mask("住北京市朝阳区光华路5号 户口：上海市黄浦区\n邮寄 100020 邮编\n编号 200010\n到朝阳区人民法院 起诉，见(2020)京01民初12号")
    assert masked == "{{ADDRESS}} 户口：{{ADDRESS}}\n邮寄 {{POSTAL_CODE}} 邮编\n编号 200010\n{{COURT}} 起诉，见{{CASE_NUMBER_1}}" and mapping["{{CASE_NUMBER_1}}"] == "(2020)京01民初12号"
    assert r.layered_mask("某市大学 某工商局 星河有限公司 中国工商银行")[0] == "{{SCHOOL}} {{GOVERNMENT}} {{ORGANIZATION}} {{FINANCIAL_INST}}"
    assert r.layered_mask("银行：北京市海淀区")[0] == "银行：{{ADDRESS}}" and r.layered_mask("第九条 一号")[0] == "第九条 一号"
    assert r.layered_mask("100020")[0] == "100020" and r.layered_mask("1000201 邮编 100020")[0] == "1000201 邮编 100020"


LEGAL = st.sampled_from(
    ["原告：张伟", "被告：张三", "张某某", "由李四承担", "13800138000", "110101199003071234", "1,000元/月", "100万元", "5%", "(2020)京01民初12号", "第十条第二款", "2020年1月2日", "北京市海淀区中关村路5号",
     "100020", "邮编", "审判长：王五", "账号：1234567890", "a.b@c.example", "https://x.example/y", "微信号：abc1234", "中国工商银行", "朝阳区人民法院", "\n\n\n", "   ", "\t\t", " ", "，", "{{PARTY_甲方}}", "{{", "}}", "\ue000", "x"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(LEGAL, max_size=14), st.sampled_from(["", "，"]))
def test_layers_are_undone_exactly(parts, between):
    text = between.join(parts)
    masked, ledger = r.layered(text)
    assert r.restored(masked, ledger) == text
    assert [text[e["start"] : e["end"]] for e in ledger] == [e["original"] for e in ledger]
    assert [masked[e["at"] : e["at"] + len(e["shown"])] for e in ledger] == [e["shown"] for e in ledger]
    for plain in ("13800138000", "110101199003071234", "a.b@c.example"):
        assert not between or plain not in masked  # numbers that touch are one number


@settings(max_examples=300, deadline=None)
@given(st.text("ab12", max_size=20), st.lists(st.tuples(st.sampled_from(["a+", "b1", "[12]+", "X+", "aX|Xb", "1X2"]), st.sampled_from(["X", "", "XX"])), max_size=5))
def test_pieces_show_what_rewriting_gives_where_no_tag_is_cut(text, layers):
    pieces, plain, whole = r.Pieces(text), text, True
    for pattern, new in layers:
        pieces.layer(pattern, lambda m, new=new: new, "k")
        plain = re.sub(pattern, new, plain)
    masked, ledger = pieces.result()
    assert r.restored(masked, ledger) == text
    if all(len(new) == 1 for _, new in layers):  # a tag of one character can't be cut
        assert masked == plain and whole


def test_people_of_one_surname_have_tags_of_their_own(spark):
    text = "被告：张伟，第三人：张三，原告：张伟"
    masked, mapping = r.layered_mask(text)
    assert masked == "被告：{{PARTY_甲方}}，第三人：{{PARTY_甲方_2}}，原告：{{PARTY_甲方}}" and mapping == {"{{PARTY_甲方}}": "张伟", "{{PARTY_甲方_2}}": "张三"}
    rows = r.layered_documents(spark.createDataFrame([(1, text), (2, None), (3, "a\t\tb 5% \U0001f600 x@y.example")], "doc_id long, text string"))
    assert [x[0] for x in rows.orderBy("doc_id").select(r.restored_text(F.col("masked"), F.col("ledger"))).collect()] == [text, "", "a\t\tb 5% \U0001f600 x@y.example"]


@settings(max_examples=300, deadline=None)
@given(st.text("aé.+-@ _", max_size=40))
def test_addresses_are_those_of_the_plain_patterns(text):
    finder = next(p for c, p, _ in r.FINDERS if c == "email")
    assert [m.span() for m in finder.finditer(text)] == [m.span() for m in re.finditer(r"[\w.+-]+@[\w-]+\.[\w.-]+", text)]
    layer = next(p for p, new in LAST_LAYERS if new == "{{EMAIL}}")
    assert [m.span() for m in re.finditer(layer, text)] == [m.span() for m in re.finditer(r"[\w.-]+@[\w.-]+\.\w+", text)]


def test_layers_are_linear_on_a_long_run():
    began = time.perf_counter()
    r.layered_mask("一" * 200_000)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("text", ["\ue0005\ue001", "第十条 \ue000\ue0000\ue001 第九条", "\ue000", "\ue0000\ue001 第十条第二款"])
def test_marks_in_a_text_stay(text):
    assert r.layered_mask(text)[0] == text


def test_numbering_across_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k")).repartition(7)
    got = r.numbered(rows, "o", "k").collect()
    for kind in "ab":
        mine = sorted((x.o, x.number) for x in got if x.k == kind)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_spans_over_whole_long_texts(spark, tmp_path):
    """span_resolve against the sequence it stands for, past the 400th span."""
    from corpusloom import plans
    from corpusloom.operators import redact

    rows = [(1, "a" * 50), (7, "word " * 3000), (3, ""), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES["span_resolve"](spark, str(tmp_path)).collect())
    want = []
    for d, text in rows:
        end = 0
        for i in range(max(min(len(text), 400), len(text) // 7) + 1 if text is not None else 0):
            if i * 7 >= end:
                end = i * 7 + 1 + (i * i + d) % 23
                want.append((d, i * 7, end))
    assert got == sorted(want) and max(b for d, _, b in got if d == 7) >= 14_900
