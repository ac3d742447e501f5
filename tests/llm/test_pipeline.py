import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from corpusloom.llm import _io as io  # noqa: E402
from corpusloom.llm import pii, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = io.table(spark, SF, "documents")
    items = brute.rows(f"{SF}/benchmark.parquet", "item_id", "text")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = {r.doc_id: r for r in out.collect()}
        if name != "mixing":
            assert out.columns == docs.columns
        assert after.keys() <= before.keys() and len(after) == out.count()
        gone = before.keys() - after.keys()
        texts = [(d, r.text) for d, r in before.items()]
        if name == "toxicity":
            model = toxicity.fit(toxicity.labelled_sample(docs, io.table(spark, SF, "labels"), "toxic"))
            lexicon = toxicity.Lexicon(model.entries)
            scores = model.scores([toxicity.figures(t, lexicon) for _, t in texts])
            assert gone == {d for (d, _), s in zip(texts, scores, strict=True) if s >= toxicity.THRESHOLD} and gone
        elif name == "ngram_jaccard":
            assert gone == {d for d, (_, c) in brute.op6(texts, 5, 80).items() if c != d} and gone
        elif name == "decontamination":
            assert gone == {d for d, r in brute.op5(texts, items).items() if r[4]} and gone
        elif name == "pii":
            assert not gone
            for d, r in after.items():
                base, added = pii.find(before[d].text)
                assert r.text == pii.masked(before[d].text, base + added) and (r.text == before[d].text or r.n_chars == len(r.text))
        else:
            assert not gone and all(r.rate >= 0 for r in after.values())
        docs = io.written(out, "test")


def test_odd_documents(spark, odd, tmp_path):
    for t in ("labels", "benchmark"):
        io.table(spark, SF, t).write.parquet(f"file://{tmp_path}/{t}.parquet")
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    kept = [r.doc_id for r in rows]
    assert 1 in kept and 2 not in kept and None in kept and {3, 4, 5} <= set(kept)
