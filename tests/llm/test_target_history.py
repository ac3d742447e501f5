import random

import pytest

from corpusloom.llm import target_history as th

SCHEMA = "sale_id long, item_id long, kind string, at long, fold int, n long, s long, slice int, value string, released boolean"


def _rows(seed, many=120):
    rng = random.Random(seed)
    out = []
    for i in range(many):
        at = rng.choice([None, 5_000_000, 5_000_000, rng.randrange(9) * 1_000_000 + rng.choice([0, 1])])
        n = rng.randrange(4)
        out.append((i // 2, rng.choice([None, -1, 7, 7, 7, rng.randrange(20)]), rng.choice([None, "a", "b"]), at, rng.choice([None, 0, 1, 2, 3, 4, 4]), n, rng.randrange(n + 1), 1, "x", True))
    return out


def _brute(rows, gap):
    rows = [r for r in rows if r[3] is not None and r[4] is not None]
    out = []
    for r in rows:
        before = [x for x in rows if x[3] + gap * 1_000_000 < r[3] and x[4] != r[4]]
        got = []
        for pick in (lambda x: x[1], lambda x: x[2], lambda x: 0):
            same = [x for x in before if pick(x) == pick(r)]
            got += [sum(x[5] for x in same), sum(x[6] for x in same)]
        out.append((*r, *got))
    return sorted(map(repr, out))


@pytest.mark.parametrize("gap, events, fan, seed", [(0, 1 << 18, 64, 1), (0, 5, 3, 2), (2, 7, 2, 3), (0, 1, 4, 4), (1000, 20, 2, 5)])
def test_history_is_brute_force(spark, monkeypatch, gap, events, fan, seed):
    monkeypatch.setattr(th, "FAN", fan)
    rows = _rows(seed)
    found = th.history(spark.createDataFrame(rows, SCHEMA), ["item_id", "kind"], gap, slice_events=events)
    assert found.columns[-6:] == ["item_id_n", "item_id_s", "kind_n", "kind_s", "all_n", "all_s"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == _brute(rows, gap)


def test_rows_of_one_moment_are_cut_into_several_slices_and_do_not_see_each_other(spark):
    rows = [(i, 7, "a", 1_000_000, i % 5, 1, i % 2, 1, "x", True) for i in range(400)] + [(i, 7, "a", 2_000_000, 0, 1, 0, 1, "x", True) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert th.sliced(df, ["item_id"], 0, 100).select("slice").distinct().count() > 4
    found = th.history(df, ["item_id"], slice_events=100).collect()
    assert {(r["at"], r.item_id_n, r.item_id_s) for r in found} == {(1_000_000, 0, 0), (2_000_000, 320, 160)}


def test_no_rows(spark):
    none = spark.createDataFrame(_rows(1), SCHEMA).limit(0)
    assert th.history(none, ["item_id"]).count() == 0


def test_rate(spark):
    from pyspark.sql import functions as F

    df = spark.sql("SELECT 0L n, 0L s UNION ALL SELECT 3L, 1L UNION ALL SELECT 10L, 10L")
    got = [r[0] for r in df.orderBy("n").select(th.rate(F.lit(500_001).cast("long"), F.col("n"), F.col("s"))).collect()]
    assert got == [500_001, (1_000_000 + 50 * 500_001) // 53, (10_000_000 + 50 * 500_001) // 60]


def test_odd_sales(spark):
    """Nulls, lines without a sale, repeated lines, an id that its table has twice, clashing columns."""
    lines = spark.createDataFrame([(1, None, 5, "returned"), (1, None, 5, "kept"), (2, 3, None, "returned"), (3, 3, 5, None), (9, 3, 5, "kept"), (None, 3, 5, "kept"), (4, 3, 5, "returned")], "sale_id long, item_id long, vendor_id long, flag string").selectExpr("*", "1 n", "2 at", "3 fold")
    sales = spark.createDataFrame([(1, 1, 1), (2, None, 2), (3, 8, None), (4, 1, 3)], "sale_id long, client_id long, day int").selectExpr("sale_id", "client_id", "timestamp_seconds(day * 86400) sold_at", "'x' flag")
    items = spark.createDataFrame([(3, "b"), (3, "a"), (None, "c")], "item_id long, kind string")
    vendors = spark.createDataFrame([(5, 2)], "vendor_id long, nation_id int")
    clients = spark.createDataFrame([(1, None)], "client_id long, segment string")
    got = {(r.sale_id, r.item_id, r.vendor_id): tuple(r)[3:] for r in th.sale_rates(lines, sales, items, vendors, clients).collect()}
    assert set(got) == {(1, -1, 5), (2, 3, None), (4, 3, 5)}
    assert got[1, -1, 5] == (2, 1, 0, 500_000, 0, 500_000, 0, 500_000)
    import zlib

    fold = {s: zlib.crc32(str(s).encode()) % 5 for s in (1, 2, 4)}
    rate = lambda p, n, s: p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)
    seen = lambda some, of: [(n, s) for k, n, s in some if fold[k] != fold[of]]
    add = lambda xs: (sum(n for n, _ in xs), sum(s for _, s in xs))
    past = [(1, 2, 1), (2, 1, 1)]
    top = rate(500_000, *add(seen(past, 4)))
    kind = rate(top, *add(seen(past[1:], 4)))
    nation = rate(top, *add(seen(past[:1], 4)))
    segment = rate(top, *add(seen(past, 4)))
    item, vendor, client = add(seen(past[1:], 4)), add(seen(past[:1], 4)), add(seen(past[:1], 4))
    assert got[4, 3, 5] == (1, 1, item[0], rate(kind, *item), vendor[0], rate(nation, *vendor), client[0], rate(segment, *client))
