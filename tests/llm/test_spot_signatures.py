import brute

from corpusloom.llm import queries as q
from corpusloom.llm import spot_signatures as sp

SF = "/root/testdata/sf0.001"


def _sets(print_):
    return {print_[i : i + 8] for i in range(0, len(print_), 8)}


def test_query_is_the_contract(spark):
    docs = sorted(brute.rows(f"{SF}/documents.parquet", "doc_id", "text"))
    rows = {r.doc_id: r for r in q.op1_spot_signatures(spark, SF).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for i, (doc, text) in enumerate(docs):
        following, r = docs[(i + 1) % len(docs)], rows[doc]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[1][:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited))
        prints.setdefault(text, r.fingerprint)
        assert prints[text] == r.fingerprint
        for other, near in ((r.edited_fingerprint, r.near_edited), (rows[following[0]].fingerprint, r.near_next)):
            a, b = _sets(r.fingerprint), _sets(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_signatures_by_hand(spark):
    df = spark.createDataFrame([(1, "the red fox and the dog"), (2, "The red, fox!  and THE dog."), (3, "red fox dog"), (4, "x"), (5, "!!"), (6, ""), (7, None)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in sp.with_signatures(df, "text", "s").collect()}
    assert got[1] == got[2] and len(got[1]) >= 1 and got[3] and len(got[4]) == len(got[5]) == 1 and got[6] == got[7] == []


def test_no_python_in_the_plan(spark):
    plan = q.op1_spot_signatures(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


def test_near_duplicates_are_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: set(r.s) for r in sp.with_signatures(df, "text", "s").select("doc_id", "s").collect()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = sets[a] | sets[b]
            if not union or len(sets[a] & sets[b]) / len(union) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert dict(sp.near_duplicates(df).collect()) == {d: root(d) for d in ids}


def test_odd_rows(odd, none):
    rows = sp.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].near_next == 1.0 and by[1].fingerprint == by[2].fingerprint
    assert by[3].fingerprint == by[4].fingerprint == "" and by[3].near_next == 1.0 and by[3].n_chars == 0
    assert by[None].edited_sha256 and by[11].n_chars == len("naïve café 北京 \U0001f600 é")
    assert sp.fingerprints(none).count() == 0
    one = sp.fingerprints(odd.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sp.near_duplicates(odd).count() == odd.where("doc_id is not null").count()
