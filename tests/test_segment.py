import itertools
import math
import random

import pytest

from corpusloom.operators import segment
from corpusloom.operators.commit_log import Store
from corpusloom.operators.grouped import GroupedIndex


def _ways(run):
    for cuts in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        yield [run[a:b] for a, b in itertools.pairwise(at)]


def test_the_cut_is_the_likeliest_of_all():
    rng = random.Random(5)
    for _ in range(60):
        words = {"".join(rng.choices("一二三四", k=rng.randrange(1, 5))): rng.randrange(1, 1000) for _ in range(8)}
        total = sum(words.values())
        lattice = segment.Lattice(words)
        score = lambda way: sum(math.log(words[w] / total) if w in words else (-math.log(total) if len(w) == 1 else -math.inf) for w in way)  # noqa: B023, E731
        run = "".join(rng.choices("一二三四五", k=rng.randrange(1, 9)))
        cut = lattice.cut(run)
        assert "".join(cut) == run and score(cut) == pytest.approx(max(map(score, _ways(run))))


def test_frequencies_decide(spark):
    lexicon = spark.createDataFrame([("研究", 900), ("研究生", 60), ("生命", 300), ("命", 20), ("起源", 200), ("研究", 1), (None, 3), ("abc", 5), ("劳动", None)], "word string, freq int")
    docs = spark.createDataFrame([(1, "研究生命起源 ABC abc_1，研究生"), (2, None), (3, ""), (4, "劳" * 3 + "劳动"), (None, "一")], "doc_id long, text string")
    got = {r.doc_id: r.toks for r in segment.segmented(docs, lexicon).collect()}
    assert got == {1: ["研究", "生命", "起源", "abc", "abc_1", "研究生"], 2: [], 3: [], 4: ["劳", "劳", "劳", "劳动"], None: ["一"]}
    # a more frequent word changes the cut
    more = lexicon.union(spark.createDataFrame([("研究生", 10**7), ("命", 10**6)], "word string, freq int"))
    assert {r.doc_id: r.toks for r in segment.segmented(docs, more).collect()}[1][:3] == ["研究生", "命", "起源"]


def test_only_folders_of_chosen_groups_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"g{i % 9}" if i % 9 else None, f"word{i % 4} common") for i in range(90)], "doc_id long, source string, text string")
    index = GroupedIndex.build(Store.create(spark, f"file://{tmp_path}/s"), docs, "doc_id", "source", folders=32)
    groups = spark.createDataFrame([(1, "g3"), (2, None), (2, "g3"), (3, "nowhere")], "query_id long, source string")
    plan = index.chosen(groups.where("query_id = 1"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan or "PartitionFilters: [isnotnull(folder" in plan
    assert {r.source for r in index.chosen(groups.where("query_id = 1")).collect()} >= {"g3"}
    queries = spark.createDataFrame([(1, "word3 word0"), (2, "word3"), (3, "common")], "query_id long, text string")
    found = index.search(groups, queries, 50).collect()
    assert {r.query_id for r in found} == {1, 2} and {r.doc_id for r in found if r.query_id == 1} == {i for i in range(90) if i % 9 == 3 and i % 4 in (0, 3)}
