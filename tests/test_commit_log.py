import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import commit_log, store
from corpusloom.operators.commit_log import Conflict, Store, StoreError

SCHEMA = "k long, v int"


@pytest.fixture
def made(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/t")
    s.add_keyed("t", _rows(spark).schema, ["k"], depth=2)
    s.add_appended("log", _rows(spark).schema)
    return s


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _last(old, new):
    return store.upsert(old, new, ["k"])


def _dict(s, number=None):
    return {r.k: r.v for r in s.read("t", number).collect()}


def test_merges_touch_their_buckets_alone(spark, made):
    made.commit({"t": (_rows(spark, *[(k, 0) for k in range(100)]), _last)})
    before = {x.name: x.folder for x in made.version().tables["t"].leaves}
    assert len(before) == 4 and None not in before.values()
    for _ in range(2):  # again: nothing changes
        made.commit({"t": (_rows(spark, (5, 1), (200, 1)), _last)})
        assert _dict(made) == {**dict.fromkeys(range(100), 0), 5: 1, 200: 1}
    after = {x.name: x.folder for x in made.version().tables["t"].leaves}
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    number = made.version().number
    made.commit({"t": (_rows(spark).limit(0), _last)})
    assert made.version().number == number


def test_buckets_split_as_they_grow(spark, made):
    want = {}
    for i in range(4):
        new = {k: i for k in range(i * 40, i * 40 + 80)}
        want |= new
        made.commit({"t": (_rows(spark, *new.items()), _last)}, most_rows=10)
        assert _dict(made) == want
    leaves = made.version().tables["t"].leaves
    assert max(x.depth for x in leaves) > 3 and sum(x.rows for x in leaves) == len(want)
    assert sum(2.0**-x.depth for x in leaves) == 1  # every row has one bucket
    again = Store(spark, made.root)  # the buckets are the log's, not the caller's
    again.commit({"t": (_rows(spark, (3, 9)), _last)})
    assert _dict(again) == {**want, 3: 9}


def test_versions_stay_readable_and_tables_change_together(spark, made):
    made.commit({"t": (_rows(spark, (1, 1)), _last)}, {"log": _rows(spark, (1, 1))})
    first = made.version().number
    made.commit({"t": (_rows(spark, (1, 2)), _last)}, {"log": _rows(spark, (1, 2))})
    assert _dict(made) == {1: 2} and _dict(made, first) == {1: 1}
    assert made.read("log").count() == 2 and made.read("log", first).count() == 1
    made.commit(replaces={"log": _rows(spark, (7, 7))})
    assert [r.k for r in made.read("log").collect()] == [7]


def test_a_writer_may_stop_anywhere(spark, made, monkeypatch):
    """After every step a reader finds the old or the new table, and the next writer goes on."""
    made.commit({"t": (_rows(spark, *[(k, 0) for k in range(20)]), _last)})
    for step in ("_hashed", "_merged", "_put", "rename", "after"):
        old = _dict(made)
        with monkeypatch.context() as patch:
            owner, name = (commit_log._Files, "rename_new") if step == "rename" else (Store, step)

            def stops(*a, **b):
                raise KeyboardInterrupt

            if step == "_merged":
                real = Store._merged
                patch.setattr(Store, "_merged", lambda *a: (real(*a), stops())[0])
            elif step == "after":
                real_put = Store._put
                patch.setattr(Store, "_put", lambda *a: (real_put(*a), stops())[0])
            else:
                patch.setattr(owner, name, stops)
            with pytest.raises(KeyboardInterrupt):
                made.commit({"t": (_rows(spark, (1, 99), (500, 5)), _last)})
        new = {**old, 1: 99, 500: 5}
        assert _dict(Store(spark, made.root)) == (new if step == "after" else old)
    made.commit({"t": (_rows(spark, (2, 7)), _last)})
    assert _dict(made) == {**new, 2: 7}
    assert made.vacuum(keep=1, older_s=-60) > 0 and _dict(made) == {**new, 2: 7}


def test_a_store_that_is_not_there_is_no_empty_table(spark, made, tmp_path):
    made.commit({"t": (_rows(spark, (1, 1)), _last)})
    made.commit({"t": (_rows(spark, (2, 1)), _last)})
    with pytest.raises(StoreError):
        Store(spark, f"file://{tmp_path}/none").read("t")
    with pytest.raises(StoreError):
        Store.create(spark, made.root)
    with pytest.raises(StoreError):
        made.read("other")
    numbers = made._numbers()
    made.files.delete(made._entry(numbers[-2]))
    with pytest.raises(StoreError):
        made.read("t")
    for n in numbers:
        made.files.delete(made._entry(n))
    for opened in (Store.create, Store.ensure):
        with pytest.raises(StoreError):
            opened(spark, made.root)


def test_a_number_is_given_once(spark, made):
    with pytest.raises(Conflict):
        made._put(commit_log.Version(0))
    with pytest.raises(StoreError):
        made.add_keyed("t", _rows(spark).schema, ["v"])
    number = made.version().number
    made.add_keyed("t", _rows(spark).schema, ["k"], depth=5)  # the same table: nothing changes
    assert made.version().number == number and len(made.version().tables["t"].leaves) == 4


def test_writers_at_once_lose_nothing(spark, made):
    failed = []

    def write(i):
        try:
            Store(spark, made.root).commit({"t": (_rows(spark, *[(k, i) for k in range(i, 200, 4)]), _last)}, {"log": _rows(spark, (i, i))})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert _dict(made) == {k: k % 4 for k in range(200)} and sorted(r.k for r in made.read("log").collect()) == [0, 1, 2, 3]


def test_a_batch_that_is_run_again_changes_nothing(spark, made):
    rows = _rows(spark, (1, 1))
    one = made.commit(appends={"log": rows}, txn=("stream", 0)).number
    assert made.commit(appends={"log": rows}, txn=("stream", 0)).number == one
    made.commit(appends={"log": rows}, txn=("stream", 1))
    assert made.read("log").count() == 2


def test_deletes(spark, made):
    made.commit({"t": (_rows(spark, *[(k, 0) for k in range(10)]), _last)})
    gone = _rows(spark, (3, None), (4, None))
    made.commit({"t": (gone, lambda old, _: store.delete(old, gone, ["k"]))})
    assert set(_dict(made)) == set(range(10)) - {3, 4}
    every = _rows(spark, *[(k, None) for k in range(10)])
    made.commit({"t": (every, lambda old, _: old.where(F.lit(False)))})
    assert _dict(made) == {}


def test_many_buckets_are_dealt_before_they_are_written(spark, made, monkeypatch):
    for direct in (64, 0):
        monkeypatch.setattr(commit_log, "DIRECT", direct)
        made.commit({"t": (_rows(spark, *[(k, direct) for k in range(100)]).repartition(3), _last)}, options={"compression": "zstd"})
        assert _dict(made) == dict.fromkeys(range(100), direct)
        files = [f for x in made.version().tables["t"].leaves for f, _ in made.files.names(f"{made.root}/data/{x.folder}/_leaf={x.name}") if f.endswith(".parquet")]
        assert all(".zstd." in f for f in files) and (len(files) > 4 if direct else len(files) == 4)
