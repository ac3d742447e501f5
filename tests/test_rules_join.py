import random

import pytest

from corpusloom.operators import rules

RULES = "rule_id string, status string, trigger struct<patterns:array<string>>"


def _brute(docs, rows):
    out = {}
    for key, text in docs:
        for rule, status, (patterns,) in rows:
            if status == "disabled":
                continue
            p = next((p for p in patterns or () if p and p in (text or "")), None)
            if p is not None:
                at = text.index(p) + 1
                start = max(1, at - 40)
                hit = (at, p, text[start - 1 : at + 119].replace("\n", " "))
                out[key, rule] = min(out.get((key, rule), hit), hit)
    return sorted(repr((k, r, p, at, s)) for (k, r), (at, p, s) in out.items())


def _rows(found):
    return sorted(repr((r.doc_id, r.rule_id, r.pattern, r.pos, r.snippet)) for r in found.collect())


def test_odd_rules_and_texts(spark):
    docs = [(1, "abcabc\nüber \U0001f600 x"), (1, "abc again, later abc"), (2, None), (3, ""), (None, "abc"), (4, "x" * 5000 + "needle"), (4, "needle")]
    rows = [("a", None, (["zzzz", "abc", "ab"],)), ("b", "disabled", (["abc"],)), ("c", "enabled", (["\U0001f600", "x"],)), ("d", "enabled", (["needle", ""],)), ("e", "enabled", (None,)), ("f", "enabled", (["über \U0001f600"],))]
    df, r = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, RULES)
    assert _rows(rules.scan_join(df, r, "doc_id")) == _brute(docs, rows) == _rows(rules.scan(df, r, "doc_id"))
    assert rules.scan_join(df, r.limit(0), "doc_id").count() == 0
    assert rules.scan_join(df.limit(0), r, "doc_id").count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_hundred_thousand_rules(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "FEW", 200_000 if broadcast else 10)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    docs = [(i, " ".join(word(rng.choice([2, 4, 7, 9])) for _ in range(60))) for i in range(60)]
    rows = [(f"r{i}", "enabled", ([word(rng.choice([6, 7, 9, 12])), word(7)],)) for i in range(100_000)]
    rows += [(f"t{i}", "enabled", ([t[5 : 5 + rng.randrange(3, 40)]],)) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(rows, RULES)
    assert _rows(rules.scan(df, table, "doc_id")) == _brute(docs, rows)  # more than an expression takes: joined


def test_pieces_are_the_report(spark, tmp_path):
    row = lambda folder, file, rule, level, text: (folder, file, rule, level, None, "why", None, text)
    rows = [row("a", 2, "r1", "high", "x"), row("a", 10, "r2", "low", "y"), row("a", 10, "r1", "medium", "z\nz"), row("b", 1, "r1", "low", ""), row("a", 10, "r1", "medium", "z\nz")]
    risks = spark.createDataFrame(rows, "folder string, doc_id long, rule_id string, risk_level string, dimension string, risk_desc string, suggestion string, snippet string")
    want = {r.folder: r.report for r in rules.report(risks, ["folder"], "doc_id").collect()}
    pieces = rules.report_pieces(risks, ["folder"], "doc_id")
    text = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.part, r.file or "", r.rule_id or "", r.place)):
        text[r.folder] = text.get(r.folder, "") + r.piece
    assert text == want
    rules.write_reports(pieces, ["folder"], f"file://{tmp_path}/reports")
    for folder, whole in want.items():
        read = spark.read.json(f"file://{tmp_path}/reports/folder={folder}").collect()
        assert sorted(r.piece for r in read) == sorted(r.piece for r in pieces.where(f"folder = '{folder}'").collect()) and sum(len(r.piece) for r in read) == len(whole)
    assert rules.report_pieces(risks.limit(0), ["folder"], "doc_id").count() == 0
