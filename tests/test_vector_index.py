import numpy as np
import pytest

from corpusloom.operators import dense
from corpusloom.operators.commit_log import Store
from corpusloom.operators.vector_index import VectorIndex

SCHEMA = "doc_id long, vector array<float>"


def _index(spark, tmp_path_factory, rows, **more):
    at = Store.create(spark, f"file://{tmp_path_factory.mktemp('v')}/s")
    return VectorIndex.build(at, spark.createDataFrame(rows, SCHEMA), "doc_id", "vector", parts=8, rounds=3, **more)


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    """Vectors around a few directions, a third of them one and the same, some null, one zero."""
    rng = np.random.default_rng(5)
    around = rng.normal(size=(12, 24))
    x = around[rng.integers(0, 12, 1200)] + 0.25 * rng.normal(size=(1200, 24))
    x[800:] = x[800]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24)]
    return rows, _index(spark, tmp_path_factory, rows, cells=16)


def _asked(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows if i % 50 == 0 and v is not None], "query_id long, vector array<float>")


def test_recall_against_all_rows_and_few_cells(spark, grouped):
    rows, index = grouped
    asked = _asked(spark, rows)
    got = {(r.query_id, r["rank"]): r.score for r in index.search(asked, 10).collect()}
    want = {(r.query_id, r["rank"]): r.score for r in dense.search(spark.createDataFrame(rows, SCHEMA), asked, 10, "doc_id", "vector").collect()}
    # by score, since many rows tie
    assert set(got) == set(want) and np.mean([abs(got[k] - want[k]) < 2e-6 for k in want]) >= 0.9
    assert index.probes <= 5


def test_every_row_is_there_once_and_cells_are_folders(spark, grouped):
    rows, index = grouped
    assert sorted(r.key for r in index.rows().select("key").collect()) == [i for i, v in rows if v is not None]
    plan = index.rows().select("key", "codes").where("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "vector" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_exact_search_and_questions_whose_cells_hold_too_little(spark, grouped):
    rows, index = grouped
    asked = _asked(spark, rows).limit(3)
    want = sorted(map(tuple, dense.search(spark.createDataFrame(rows, SCHEMA), asked, 5, "doc_id", "vector").collect()))
    assert sorted(map(tuple, index.search(asked, 5, exact=True).collect())) == want
    most = index.search(asked, 1000, probes=1)  # no cell holds so many: all are looked at
    assert most.count() == 3 * 1000


def test_few_or_no_rows(spark, tmp_path_factory):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])]
    index = _index(spark, tmp_path_factory, rows, cells=4)
    asked = spark.createDataFrame([(7, [1.0, 0.1, 0.0]), (8, None)], "query_id long, vector array<float>")
    assert [(r.query_id, r.key) for r in index.search(asked, 5).orderBy("rank").collect()] == [(7, 1), (7, 2)]
    none = _index(spark, tmp_path_factory, [(1, None)], cells=4)
    assert none.search(asked, 5).count() == 0
