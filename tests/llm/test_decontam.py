import brute
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import decontam as d
from corpusloom.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_query_is_the_contract(spark):
    got = {r[0]: tuple(r)[1:] for r in q.op5_decontaminate(spark, SF).collect()}
    assert got == brute.op5(brute.rows(f"{SF}/documents.parquet", "doc_id", "text"), brute.rows(f"{SF}/benchmark.parquet", "item_id", "text"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB,é \n", max_size=60), max_size=4), st.text("aB,é \n", max_size=120), st.integers(1, 4))
def test_scan_is_brute_force(items, text, window):
    items = list(enumerate(items))
    machines = d.automata([(str(i), t) for i, t in items], window)
    n, spans, ids = d.scan(text, machines)
    want = brute.op5([(0, text)], items, window)[0]
    assert (n, sum(b - a for a, b in spans), len(ids), d.digest(list(ids))) == want[:4]


def test_small_automata_find_the_same():
    items = [(str(i), f"alpha beta gamma{i} delta epsilon") for i in range(9)]
    text = "x alpha beta gamma3 delta epsilon y Alpha, beta; gamma5 DELTA epsilon"
    assert d.scan(text, d.automata(items)) == d.scan(text, d.automata(items, most=40))
    assert len(list(d.automata(items, most=40))) > 1


def test_offsets_are_of_the_original(spark):
    text = "Intro:  The QUICK, brown—fox jumps! End"
    items = spark.createDataFrame([(1, "the quick brown—fox jumps")], "item_id long, text string")
    row = d.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).first()
    (a, b), = row.char_spans
    assert text[a:b] == "The QUICK, brown—fox jumps" and row.contaminated


def test_a_pass_for_each_automaton_finds_the_same(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id", "text").union(spark.createDataFrame([("9", "the cat sat on the mat and the dog ran to a house by the sea with all of its friends"), ("10", "one")], "item_id string, text string"))
    whole = sorted(map(repr, d.contamination(docs, items).collect()))
    monkeypatch.setattr(d, "MAX_PATTERN_CHARS", 15_000)
    rows = [(str(i), t) for i, t in items.collect()]
    assert len(list(d.automata(rows))) > 2
    assert sorted(map(repr, d.contamination(docs, items).collect())) == whole


def test_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran to a house by the sea"), (2, None), (3, ""), (None, "x"), (4, "one")], "item_id long, text string")
    rows = d.contamination(odd, items).collect()
    assert len(rows) == odd.count()
    assert [r.contaminated for r in rows if r.doc_id == 2] == [True, True]
    assert all(r.n_words == 0 and not r.contaminated and r.n_hit == 0 for r in rows if r.doc_id in (3, 4, 5, 7))
    assert [r["items"] for r in rows if r.doc_id == 6] == [["4"]]
    assert d.contamination(none, items).count() == 0
    assert not any(r.contaminated for r in d.contamination(odd, items.limit(0)).collect())
