import math
import zlib

import numpy as np
import pytest

from corpusloom.llm import mixing, quality_eb, toxicity
from corpusloom.llm import queries as q

SF = "/root/testdata/sf0.01"


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    import random

    rng = random.Random(3)
    terms = ["idiot", "moron", "pathetic", "abcab", "aabb"]
    lexicon = toxicity.Lexicon([toxicity.Entry(t, 1.0, False, e) for t, e in zip(terms, (1, 2, 2, 1, 0), strict=True)])
    words = ["".join(rng.choice("abcidomrntphe") for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "o"])
            words.append("".join(w) or "x")
    for w in words:
        want = {(k, _levenshtein(w, e.term)) for k, e in enumerate(lexicon.entries) if _levenshtein(w, e.term) <= e.edits}
        assert set(lexicon.match(w)) == want, w


def test_stems_and_context():
    lexicon = toxicity.Lexicon([toxicity.Entry("foolis", 1.0, True), toxicity.Entry("idiot", 1.0, False, 1)])
    assert lexicon.match("foolishness") == ((0, 0),) and lexicon.match("foolis") == () and lexicon.match("idoit") == ()
    assert lexicon.match("idiott") == ((1, 1),)
    text = 'He wrote "idiot" twice'
    assert toxicity.context(text, text.index("idiot"), text.index("idiot") + 5)[0]
    text = "you are an idiot!"
    assert toxicity.context(text, text.index("idiot"), len(text) - 1) == (False, True)


def test_stems_have_edits():
    import random

    rng = random.Random(4)
    entries = [toxicity.Entry(t, 1.0, True, e) for t, e in (("foolis", 1), ("abcabcab", 2), ("bcda", 0))]
    lexicon = toxicity.Lexicon(entries)
    words = ["fuolishness", "folishness", "foolxishness", "foolis", "abcxbcabword", "bcdxe", "bcdae"]
    words += ["".join(rng.choice("abcdfolis") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    words += [w[:at] + rng.choice(["", "x"]) + w[at + 1 :] + "abc" for w in ("foolis", "abcabcab", "bcda") for at in range(len(w)) for _ in range(4)]
    for w in words:
        least = [min((_levenshtein(w[:n], e.term) for n in range(1, len(w))), default=9) for e in entries]
        assert set(lexicon.match(w)) == {(k, n) for k, (n, e) in enumerate(zip(least, entries, strict=True)) if n <= e.edits}, w
    assert lexicon.match("fuolishness") == ((0, 1),)


def test_learnt_stems_match_misspelt():
    clean = [(f"plain words about the {w} and a quiet day", 0) for w in "river garden market village harbour forest".split() * 40]
    toxic = [(f"you grimlok{end} of a day", 1) for end in ("ing", "ers", "ism", "est", "ard", "ous") * 8] + [("you grimlok of a day", 1)] * 30
    terms = {(e.term, e.stem) for e in toxicity.learn_terms(clean + toxic)}
    assert any(s and "grimlok".startswith(t) for t, s in terms)
    model = toxicity.fit(clean + toxic)
    lexicon = toxicity.Lexicon(model.entries)
    assert all(lexicon.match(w) for w in ("grimlok", "grimloking", "grxmloking", "gimlokers"))


def test_a_word_equal_to_a_stem_is_learnt():
    clean = [("plain words about a quiet day", 0)] * 300
    toxic = [(f"grimlok{end} day", 1) for end in ("ing", "ers", "ism", "est", "ard", "ous") * 10] + [("grimlok day", 1)] * 9
    toxic += [(f"grim{end} day", 1) for end in ("ace", "oire") * 10] + [("grim day", 1)] * 9
    entries = toxicity.learn_terms(clean + toxic)
    stems = [e.term for e in entries if e.stem]
    assert stems and any(e.term in stems for e in entries if not e.stem)


def test_toxicity_query_on_held_out_rows(spark):
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect())
    rows = q.op10_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.9
    assert np.mean([b for a, b in held if not a]) <= 0.05


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - toxic else toxic end toxic")
    score = lambda x: {r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()}
    assert score(labels) == score(other)


@pytest.mark.parametrize("kind", ["toxicity", "quality", "mixing"])
def test_odd_rows(spark, odd, none, kind):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    run = {"toxicity": lambda d: toxicity.toxicity(d, labels), "quality": lambda d: quality_eb.quality(d, labels), "mixing": lambda d: mixing.mixed(d, d, "lang").rows}[kind]
    rows = run(odd).collect()
    assert len(rows) == odd.count() and run(none).count() == 0
    value = "rate" if kind == "mixing" else "score"
    assert all(np.isfinite(r[value]) for r in rows)
    by = {r.doc_id: r[value] for r in rows}
    assert by[3] == by[4]


def test_quality_on_held_out_rows(spark):
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    rows = q.op8_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert np.mean([b for a, b in held if a]) >= 0.97  # clean documents stay


def test_figures_are_brute_force():
    """Hits, near hits and their contexts, each word against each entry by edit distance."""
    import random

    rng = random.Random(9)
    entries = [toxicity.Entry("moron", 2.0, False, 1), toxicity.Entry("foolis", 1.5, True, 1), toxicity.Entry("scum", 3.0)]
    parts = ["moron", "morron", "mor0n", "foolishness", "fuolishly", "scum", "scums", "you", "said", "«", "»", '"', "!", "a", "quiet", "averyveryverylongwordofthetextthatgoesonandonandonandonandon", "\n"]
    for _ in range(150):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(80))).replace('" ', '"')
        words = toxicity._WORD.findall(text)
        match = {}
        for w in {w.lower() for w in words}:
            own = [(min((_levenshtein(w[:n], e.term) for n in range(1, len(w))), default=9) if e.stem else _levenshtein(w, e.term), -e.weight, k) for k, e in enumerate(entries)]
            own = [x for x in own if x[0] <= entries[x[2]].edits]
            if own:
                match[w] = min(own)
        hits = [(i, match[w.lower()]) for i, w in enumerate(words) if w.lower() in match]
        got = toxicity.figures(text, toxicity.Lexicon(entries))
        assert got[2] == math.log1p(len(hits)) and got[3] == len({m[2] for _, m in hits})
        assert got[5] == sum(m[0] > 0 for _, m in hits) / (len(hits) + 1)
        around = lambda i: {w.lower() for w in words[max(0, i - toxicity.CONTEXT) : i] + words[i + 1 : i + 1 + toxicity.CONTEXT]}
        said = sum(bool(around(i) & toxicity.SAYING) for i, _ in hits)
        assert said <= round(got[6] * (len(hits) + 1)) <= len(hits)
        to = sum(bool(around(i) & toxicity.ADDRESS) for i, _ in hits)
        assert to <= round(got[7] * (len(hits) + 1)) <= len(hits)


def test_many_different_hits_are_linear():
    import random
    import time

    rng = random.Random(1)
    lexicon = toxicity.Lexicon([toxicity.Entry("foolis", 1.0, True, 1)])
    text = " ".join("foolis" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40_000))
    began = time.time()
    assert toxicity.figures(text, lexicon)[2] == math.log1p(40_000) and time.time() - began < 30


def test_learnt_terms_alone_tell_toxic_texts(spark, monkeypatch):
    """Held-out accuracy without the fixed list."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "INSULTS", [])
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, "toxic"))
    held = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    assert model.entries and np.mean([a == b for a, b in held]) >= 0.95 and np.mean([b for a, b in held if a]) >= 0.8


def test_combine_is_brute_force(spark):
    """Leave-one-out posteriors with moment estimates, group by group."""
    rng = np.random.default_rng(5)
    rows = [(i, f"h{rng.integers(6)}" if i % 17 else None, f"p{rng.integers(3)}", float(rng.uniform(0.01, 0.99))) for i in range(400)] + [(900, "alone", "p0", 0.25)]
    got = {r.doc_id: r for r in quality_eb.combine(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double"), "host", "path").collect()}

    def grouped(*at):
        out = {}
        for r in rows:
            out.setdefault(tuple(r[i] for i in at), []).append(r[3])
        return out

    hosts, paths = grouped(1), grouped(1, 2)
    mean = np.mean([r[3] for r in rows])

    def k_of(groups, center):
        n = sum(map(len, groups.values()))
        within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / (n - len(groups))
        apart = sum(len(v) * (np.mean(v) - center(g)) ** 2 for g, v in groups.items()) / (len(groups) - 1)
        size = (n - sum(len(v) ** 2 for v in groups.values()) / n) / (len(groups) - 1)
        return quality_eb.strength(mean, within, max(0.0, (apart - within) / size))

    k_host, k_path = k_of(hosts, lambda g: mean), k_of(paths, lambda g: np.mean(hosts[g[:1]]))
    logit = lambda p: np.log(p / (1 - p))
    for doc, host, path, own in rows:
        h, p = hosts[host,], paths[host, path]
        host_posterior = (sum(h) - own + k_host * mean) / (len(h) - 1 + k_host)
        path_posterior = (sum(p) - own + k_path * host_posterior) / (len(p) - 1 + k_path)
        score = 1 / (1 + np.exp(-(logit(own) + logit(path_posterior) - logit(mean))))
        r = got[doc]
        assert np.allclose([r.host_posterior, r.path_posterior, r.score], [host_posterior, path_posterior, score], rtol=1e-9)
    tie = quality_eb.combine(spark.createDataFrame([(1, "a", "b", 0.5), (2, "a", "b", 0.5)], "doc_id long, host string, path string, evidence double"), "host", "path").collect()
    assert [r.score for r in tie] == [0.5, 0.5]  # at the threshold: kept


def test_shrinkage_by_hand(spark):
    rows = spark.createDataFrame([(i, "big", "a", 0.9) for i in range(50)] + [(100 + i, "bad", "b", 0.1) for i in range(50)] + [(200, "new", "c", 0.1)], "doc_id long, host string, path string, evidence double")
    by = {r.doc_id: r for r in quality_eb.combine(rows, "host", "path").collect()}
    assert by[0].path_posterior > 0.8 and by[100].path_posterior < 0.2
    assert abs(by[200].path_posterior - by[200].host_posterior) < 0.05 and 0.3 < by[200].host_posterior < 0.7
    same = quality_eb.combine(rows.where("host = 'big'"), "host", "path").collect()
    assert len(same) == 50


def test_rates_meet_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fit = mixing.mixed(docs, docs, "lang", {"en": 0.5, "fr": 0.3, "de": 0.2, "es": 0.0})
    rows = fit.rows.collect()
    tokens = sum(r.tokens for r in rows)
    totals = sum(np.array(r.posterior) * r.tokens * r.rate for r in rows)
    want = tokens * np.array([{"en": 0.5, "fr": 0.3, "de": 0.2, "es": 0.0}[d] for d in fit.domains])
    assert min(r.rate for r in rows) >= 0 and np.abs(totals - want).max() <= 0.01 * tokens
    lang = dict(docs.select("doc_id", "lang").collect())
    assert np.mean([fit.domains[int(np.argmax(r.posterior))] == lang[r.doc_id] for r in rows]) >= 0.98


def _members(spark, t, p):
    return spark.createDataFrame([(i, int(n), row.tolist()) for i, (n, row) in enumerate(zip(t, p, strict=True))], "doc_id long, tokens long, posterior array<double>").coalesce(1)


def _is_least(t, p, rate, targets):
    """Nearest rates to 1 that meet the targets: rate = max(0, 1 - p . force) for some force."""
    free = rate > 1e-9
    force = np.linalg.lstsq(p[free], 1 - rate[free], rcond=None)[0]
    return np.abs((t * rate) @ p - targets).max() <= 2e-5 * t.sum() and np.allclose(rate, np.maximum(0, 1 - p @ force), atol=1e-5)


def _rates(fit):
    return np.array([r.rate for r in fit.rows.orderBy("doc_id").collect()])


def test_rates_are_the_least_squares(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    t = rng.integers(1, 500, 200)
    fit = mixing.fit_rates(_members(spark, t, p), ["a", "b", "c"], {"a": 0.9, "b": 0.1})
    rate = _rates(fit)
    assert rate.min() >= 0 and (rate == 0).any()
    # c has a part in every document, so its share can't be 0: no smaller squares by plain projected gradient
    target = t.sum() * np.array([0.9, 0.1, 0.0])
    squares = lambda r: (((t * r) @ p - target) ** 2).sum() / t.sum() ** 2
    other, step = np.ones(200), 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    for _ in range(20_000):
        other = np.maximum(0, other - step * (p @ ((t * other) @ p - target)))
    assert fit.converged and squares(rate) <= squares(other) + 1e-6


@pytest.mark.parametrize(("seed", "alpha", "k", "shares"), [(1, 4.0, 5, (0.24, 0.22, 0.2, 0.18, 0.16)), (2, 2.0, 4, (0.25,) * 4), (3, 1.0, 4, (0.55, 0.15, 0.15, 0.15)), (4, 30.0, 3, (0.36, 0.33, 0.31))])
def test_soft_posteriors_converge(spark, seed, alpha, k, shares):
    rng = np.random.default_rng(seed)
    t, p = rng.integers(1, 500, 400), rng.dirichlet([alpha] * k, 400)
    fit = mixing.fit_rates(_members(spark, t, p), list("abcde")[:k], dict(zip("abcde", shares, strict=False)))
    assert fit.converged and fit.miss <= 2e-5 and _is_least(t, p, _rates(fit), fit.targets)


def test_the_end_of_the_fit_is_told(spark, monkeypatch):
    t, p = np.array([100, 100, 100]), np.full((3, 3), 1 / 3)
    fit = mixing.fit_rates(_members(spark, t, p), list("abc"), {"a": 1.0})  # can't be met, and at rest at once
    assert fit.converged and fit.steps < 3 and fit.miss > 0.5
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 3)
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.warns(RuntimeWarning, match="not converged"):
        assert not mixing.fit_rates(_members(spark, t, p), list("abc"), {"a": 0.9, "b": 0.1}).converged
