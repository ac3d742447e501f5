import io
import json
import zipfile

from pyspark.sql import functions as F

from corpusloom.sources import files, markup, office


def test_markdown(spark):
    text = "# Title\npara one\nstill one\n\npara two\n```python\n# not a heading\n\ncode\n```\n## Sub \nend\n```\nlost"
    rows = markup.markdown_blocks(spark.createDataFrame([(1, text), (2, ""), (3, "plain")], "doc_id long, text string")).orderBy("doc_id", "order").collect()
    assert [(r.type, r.content, r.level, r.language) for r in rows if r.doc_id == 1] == [
        ("heading", "Title", 1, None),
        ("paragraph", "para one\nstill one", None, None),
        ("paragraph", "para two", None, None),
        ("code", "# not a heading\n\ncode", None, "python"),
        ("heading", "Sub", 2, None),
        ("paragraph", "end", None, None),
    ]
    assert [(r.type, r.content) for r in rows if r.doc_id == 3] == [("paragraph", "plain")] and not [r for r in rows if r.doc_id == 2]


def test_legal_blocks(spark):
    lines = [("民法", 22.0), ("目 录", 0.0), ("第一章 总则", 0.0), ("", 0.0), ("（2020年通过）", 0.0), ("序 言", 0.0), ("第一章 总则", 0.0), ("第一节 一般", 0.0), ("第一条 甲", 0.0), ("款", 0.0), ("第二章 人", 0.0), ("第二条 乙", 0.0)]
    df = spark.createDataFrame([("d", i, t, f) for i, (t, f) in enumerate(lines)], "doc_id string, idx int, text string, max_font_pt double")
    rows = markup.legal_blocks(df).orderBy("order").collect()
    assert [(r.kind, r.level) for r in rows] == [("heading", 1), ("enactment_date", None), ("heading", 2), ("heading", 2), ("heading", 3), ("article", None), ("text", None), ("heading", 2), ("article", None)]
    assert rows[5].article_number == 1 and rows[6].article == 1 and rows[6].section == "第一节 一般"
    assert rows[8].chapter == "第二章 人" and rows[8].section is None
    assert markup.is_legal(df).first().legal
    paths = markup.heading_paths(rows_to_blocks(spark, rows)).orderBy("order").collect()
    assert paths[5].heading_path == ["民法", "第一章 总则", "第一节 一般"] and paths[8].heading_path == ["民法", "第二章 人"]


def rows_to_blocks(spark, rows):
    return spark.createDataFrame([(r.doc_id, r.order, r.type, r.content, r.level) for r in rows], "doc_id string, order int, type string, content string, level int")


def _docx(body):
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark):
    p = lambda t, style="", size="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:rPr>{f"""<w:sz w:val="{size}"/>""" if size else ""}</w:rPr><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    good = _docx(p("T", "Heading 1", "44") + p("x") + table + p("y", "标题2"))
    rows = office.docx_blocks(spark.createDataFrame([("d", good), ("bad", b"zip?")], "doc_id string, content binary")).orderBy("doc_id", "order").collect()
    assert rows[0].type == "error"
    assert [(r.type, r.content, r.level) for r in rows[1:]] == [("heading", "T", 1), ("paragraph", "x", None), ("table", "", None), ("heading", "y", 2)]
    assert rows[1].max_font_pt == 22.0 and rows[3].headers == ["a", "b"] and rows[3].rows == [["1", "2"]]


def _chars(lines):
    """(page, top, size, x0, text) lines as characters."""
    return [("d", page, c, float(size), "f", float(top), float(top + size), float(x0 + i * size), float(x0 + (i + 1) * size)) for page, top, size, x0, text in lines for i, c in enumerate(text)]


CHARS = "doc_id string, page int, text string, size double, fontname string, top double, bottom double, x0 double, x1 double"


def test_pdf_layout(spark):
    lines = [(1, 10, 20, 50, "大标题"), (1, 60, 10, 50, "第一段开头"), (1, 72, 10, 50, "第一段续"), (1, 120, 10, 50, "第二段到页底"), (2, 10, 10, 50, "接着第二段"), (2, 60, 10, 50, "第一章 总则"), (2, 80, 10, 50, "正文"), (2, 200, 60, 50, "巨")]
    chars = spark.createDataFrame(_chars(lines), CHARS)
    assert office.body_font(chars).first().body == 10.0
    rows = office.layout_blocks(chars).orderBy("order").collect()
    assert [(r.type, r.content, r.level) for r in rows] == [("heading", "大标题", 1), ("paragraph", "第一段开头第一段续", None), ("paragraph", "第二段到页底接着第二段", None), ("heading", "第一章 总则", 1), ("paragraph", "正文", None), ("heading", "巨", 1)]


def test_pdf_tables_images_columns(spark):
    t = spark.createDataFrame([("d", 1, 0, ["a", "b"], [["1", "2"]], 0.5), ("d", 2, 0, ["a", "b"], [["3", "4"]], 0.1), ("d", 3, 0, ["a", "b"], [["5", "6"]], 0.1), ("d", 5, 0, ["x"], [["7"]], 0.1)], "doc_id string, page int, table_no int, headers array<string>, rows array<array<string>>, table_top_ratio double")
    assert [(r.page, r.rows) for r in office.merged_tables(t).orderBy("page").collect()] == [(1, [["1", "2"], ["3", "4"]]), (3, [["5", "6"]]), (5, [["7"]])]
    images = spark.createDataFrame([("d", 1, 0, 100.0, 200.0, 40.0, 90.0), ("d", 2, 0, 1.0, 2.0, 1.0, 2.0)], "doc_id string, page int, image int, top double, bottom double, x0 double, x1 double")
    chars = spark.createDataFrame(_chars([(1, 210, 10, 50, "图注"), (1, 400, 10, 50, "远"), (1, 210, 10, 500, "旁")]), CHARS)
    assert {r.page: r.alt for r in office.image_texts(images, chars).collect()} == {1: "图注", 2: None}
    lines = spark.createDataFrame([("d", p, n, 50.0 if n % 2 else 300.0) for p in (1, 2) for n in range(8)], "doc_id string, page int, line int, x0 double")
    got = office.column_order(lines).where("page = 1").orderBy("reading").collect()
    assert [r.line for r in got] == [1, 3, 5, 7, 0, 2, 4, 6]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("# X")
    (tmp_path / "y.txt").write_text("y")
    (tmp_path / "z.bin").write_text("z")
    found = files.scan_folder(spark, str(tmp_path))
    assert sorted(r.relpath for r in found.collect()) == ["a/x.md", "y.txt"]
    blocks = files.by_extension(found.select("relpath", F.col("doc_id"), F.col("content").cast("string").alias("text")), {"md": lambda d: markup.markdown_blocks(d), "txt": lambda d: files.paragraph_blocks(d, "doc_id")})
    assert sorted((r.type, r.content) for r in blocks.collect()) == [("heading", "X"), ("paragraph", "y")]


def test_rules_lexicon_skills_config(spark, tmp_path):
    good = {"rule_id": "r1", "trigger": {"patterns": ["x"]}, "basis": [{"law": "a", "article": "1"}]}
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\nnot json\n" + json.dumps({"rule_id": "r2", "status": "disabled"}) + "\n" + json.dumps({"rule_id": "r3"}) + "\n")
    rows = files.rules(spark, [str(tmp_path / "r.jsonl")]).cache().collect()
    assert sorted(r.rule_id for r in rows if r.rule_id) == ["r1", "r3"] and [r.corrupt for r in rows if r.corrupt] == ["not json"]
    (tmp_path / "lex.txt").write_text("# c\n劳动合同 500 nz\n公司\n\n法 x\n")
    assert [tuple(r) for r in files.lexicon(spark, str(tmp_path / "lex.txt")).collect()] == [("劳动合同", 500, "nz"), ("公司", 10000, "n"), ("法", 10000, "n")]
    (tmp_path / "SKILL.md").write_text('---\nname: "审查"\nversion: 1.0\nsteps:\n  - id: a\n---\nBody\n')
    row = files.skills(spark, str(tmp_path / "SKILL.md")).first()
    assert row.meta == {"name": "审查", "version": "1.0"} and row.body == "Body"
    assert files.merged_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}
    assert files.public_config({"llm": {"api_key": "k", "model": "m"}}) == {"llm": {"api_key": "***", "api_key_set": True, "model": "m"}}
