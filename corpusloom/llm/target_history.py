"""Target encoding in the order of time: what of a row's values was known before it.

For each row and column `history` gives how many earlier units of other folds share the row's
value, and how many of these are hits. Time is the major order:

1. Every row is two events: it asks at its own moment, and is released to later rows `gap` after
   it. The events are cut by range of (moment, asking first, a hash) into slices of about
   SLICE_EVENTS; a moment that very many rows share is cut as any other place is, since what is
   released at a moment is seen by later ones alone.
2. The counts of each slice by (column, value) and fold are summed up over the slices before it,
   and written: the state that a slice starts with, for the values it asks for. The sums go by
   levels of FAN slices, blocks of FAN slices and so on, so that no value's history, however
   frequent, passes one task: a window has FAN rows at most.
3. The slices are replayed in parallel. A slice maps its values to slots that hold its first state;
   a pointer goes through the rows that ask, a second one through the queue of those to be
   released, and each asking row takes its slot's counts less those of its own fold.

Nothing that grows passes the driver, but for the count of rows and the number of the last slice.

Defined results: null is a value of its own in a column, shared by the rows that have it; repeated
rows count each; rows without a moment or fold are left out; rows of one moment don't see each
other (with gap 0); a row of weight 0 asks and adds nothing; no rows give no rows. In `sale_rates`
a null item or client is -1, as is an id of -1, a null vendor stays null; a sale that is there
several times has its lines several times; an id that its own table has several times takes the
least kind, nation or segment there; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from . import _io as io

SLICE_EVENTS = 1 << 18
FAN = 64
FOLDS = 5


_OWN = {"at": "long", "fold": "int", "n": "long", "s": "long"}


def _sums(folds: int) -> list[str]:
    return [f"{what}{f}" for what in "ns" for f in range(folds)]


def sliced(rows: DataFrame, keys: Sequence[str], gap: int, slice_events: int, keep: Sequence[str] | None = None) -> DataFrame:
    """Both events of every row with the number of their slice, in the order of time. A released
    event keeps its values, fold and weights only, one that asks `keep` besides."""
    own = ["fold", "n", "s", *[F.col(k).cast("string").alias(f"key{i}") for i, k in enumerate(keys)]]
    carried = [(F.col(c), t, f"c{i}") for i, (c, t) in enumerate(rows.dtypes) if c not in _OWN and (keep is None or c in keep)]
    asking = rows.select(F.col("at").alias("moment"), F.lit(False).alias("released"), *own, *[c.alias(a) for c, _, a in carried])
    due = rows.select((F.col("at") + F.lit(gap)).alias("moment"), F.lit(True).alias("released"), *own, *[F.lit(None).cast(t).alias(a) for _, t, a in carried])
    events = asking.union(due)
    spread = F.xxhash64(*events.columns)
    n = max(1, -(-2 * rows.count() // slice_events))
    return events.repartitionByRange(n, "moment", "released", spread).withColumn("slice", F.spark_partition_id().cast("long"))


def _levels(counts: DataFrame, names: list[str]) -> DataFrame:
    """slice, col, value, and for each of `names` its sum over earlier slices; of values asked for."""
    last = counts.agg(F.max("slice")).first()[0] or 0
    level, width, parts = counts, 1, []
    while True:
        block = F.floor(F.col("slice") / F.lit(width * FAN)).cast("long")
        before = Window.partitionBy("col", "value", block).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        asked = ["asked"] if width == 1 else []
        parts.append(level.select("slice", "col", "value", *asked, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names]))
        if last < width * FAN:
            break
        level = io.written(level.groupBy(block.alias("block"), "col", "value").agg(*[F.sum(c).alias(c) for c in names]).withColumn("slice", F.col("block") * F.lit(width * FAN)).drop("block"), "history-level")
        width *= FAN
    state, width = parts[0].where("asked").drop("asked"), 1
    for part in parts[1:]:
        width *= FAN
        upper = part.select(F.col("slice").alias("block"), F.col("col").alias("col_"), F.col("value").alias("value_"), *[F.col(c).alias(f"{c}_") for c in names])
        on = (F.floor(F.col("slice") / F.lit(width)).cast("long") * F.lit(width) == F.col("block")) & (F.col("col") == F.col("col_")) & F.col("value").eqNullSafe(F.col("value_"))
        state = state.join(upper.hint("merge"), on).select("slice", "col", "value", *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in names])
    return state


def states(events: DataFrame, n_keys: int, folds: int) -> DataFrame:
    """For each slice and (col, value) that it asks for, counts n0.., s0.. by fold at its start.
    Column n_keys is all rows together."""
    names = _sums(folds)
    values = [F.struct(F.lit(i).alias("col"), F.col(f"key{i}").alias("value")) for i in range(n_keys)]
    every = F.struct(F.lit(n_keys).alias("col"), F.lit(None).cast("string").alias("value"))
    each = events.select("slice", "released", "fold", "n", "s", F.explode(F.array(*values, every)).alias("key"))
    of = lambda what, f: F.sum(F.when(F.col("released") & (F.col("fold") == f), F.col(what)).otherwise(F.lit(0))).alias(f"{what}{f}")
    counts = each.groupBy("slice", F.col("key.col").alias("col"), F.col("key.value").alias("value")).agg(F.max(~F.col("released")).alias("asked"), *[of(what, f) for what in "ns" for f in range(folds)])
    return _levels(io.written(counts, "history-counts"), names)


def _before(slot: np.ndarray, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each event in their order, the weight of earlier ones of its slot but not of its own
    group within it; `own` is the number of that group."""
    out = np.zeros(weight.shape, dtype=np.int64)
    for codes, sign in ((slot, 1), (own, -1)):
        order = np.argsort(codes, kind="stable")
        run = np.cumsum(weight[:, order], axis=1)
        heads = np.flatnonzero(np.diff(codes[order], prepend=codes[order[0]] - 1)) if len(order) else order
        base = np.concatenate((np.zeros((len(weight), 1), dtype=np.int64), run), axis=1)[:, heads]
        inner = run - np.repeat(base, np.diff(np.append(heads, len(order))), axis=1)
        out[:, order] += sign * inner
    return out


def replay(events: pa.Table, state: pa.Table, n_keys: int, folds: int) -> list[np.ndarray]:
    """Of the asking events, in their order of time: row numbers in `events`, and per column n and s."""
    number = lambda c: events.column(c).to_numpy()
    moment, released = number("moment"), events.column("released").combine_chunks().to_numpy(zero_copy_only=False)
    asks, queue = np.flatnonzero(~released), np.flatnonzero(released)
    asks, queue = asks[np.argsort(moment[asks], kind="stable")], queue[np.argsort(moment[queue], kind="stable")]
    # the second pointer: how much of the queue is released before each row that asks
    seen = np.searchsorted(moment[queue], moment[asks], side="left")
    place = np.empty(len(events), dtype=np.int64)
    place[np.arange(len(asks)) + seen] = asks
    place[np.arange(len(queue)) + np.searchsorted(seen, np.arange(len(queue)), side="right")] = queue
    fold = number("fold").astype(np.int64)[place]
    waits = ~released[place]
    weight = np.stack([np.where(waits, 0, number(c)[place]) for c in "ns"])
    col = state.column("col").to_numpy()
    first = np.stack([np.stack([state.column(f"{what}{f}").to_numpy() for f in range(folds)], axis=1) for what in "ns"]) if len(state) else np.zeros((2, 0, folds), dtype=np.int64)
    out = [place[waits]]
    for k in range(n_keys + 1):
        mine = np.flatnonzero(col == k)
        if k < n_keys:
            slots = state.column("value").take(pa.array(mine)).combine_chunks()
            slot = pc.fill_null(pc.index_in(events.column(f"key{k}"), value_set=slots), -1).to_numpy().astype(np.int64)[place]
        else:
            slot = np.zeros(len(events), dtype=np.int64)
        since = _before(slot, slot * folds + fold, weight)[:, waits]
        start = first[:, mine[slot[waits]]] if len(mine) else np.zeros((2, 0, folds), dtype=np.int64)
        others = start.sum(axis=2) - np.take_along_axis(start, np.broadcast_to(fold[waits][None, :, None], (2, int(waits.sum()), 1)), axis=2)[:, :, 0]
        out += list(others + since)
    return out


def history(rows: DataFrame, keys: Sequence[str], gap_seconds: int = 0, folds: int = FOLDS, slice_events: int = SLICE_EVENTS, keep: Sequence[str] | None = None) -> DataFrame:
    """rows (of their columns those in `keep`, by default all), which have `at` (microseconds), `fold` (0 to folds - 1), `n` and `s` (units and hits of
    the row), with {key}_n and {key}_s for each key, and all_n, all_s: units and hits of other folds
    whose `at` is more than gap_seconds earlier and which share the row's value. A key's name must
    not make one of rows' columns."""
    rows = rows.where("at is not null and fold is not null").withColumns({c: F.col(c).cast(t) for c, t in _OWN.items()})
    rows = io.written(rows, "history-rows")
    events = io.written(sliced(rows, keys, gap_seconds * 1_000_000, slice_events, keep), "history-events")
    state = io.written(states(events, len(keys), folds), "history-state")
    names = [f"{k}_{what}" for k in [*keys, "all"] for what in "ns"]
    columns, n_keys = [c for c in rows.columns if keep is None or c in keep], len(keys)
    named = {"at": "moment", **{c: c if c in _OWN else f"c{i}" for i, c in enumerate(rows.columns) if c != "at"}}
    schema = StructType([*[rows.schema[c] for c in columns], *[StructField(n, LongType()) for n in names]])

    def run(some: pa.Table, first: pa.Table) -> pa.Table:
        at, *counts = replay(some, first, n_keys, folds)
        kept = some.select([named[c] for c in columns]).take(pa.array(at))
        return pa.table([*kept.columns, *map(pa.array, counts)], names=[*columns, *names])

    return events.groupBy("slice").cogroup(state.groupBy("slice")).applyInArrow(run, schema)


def fold_of(id_: Column, folds: int = FOLDS) -> Column:
    return (F.crc32(id_.cast("string").cast("binary")) % folds).cast("int")


def rate(prior: Column, n: Column, s: Column, strength: int = 50) -> Column:
    """Hits in a million, drawn to `prior` by `strength` units; `prior` itself without any unit."""
    whole = F.lit(1_000_000) * s + F.lit(strength) * prior
    return F.when(n < 1, prior).otherwise(F.call_function("div", whole, n + F.lit(strength)))


#: Column of a line, and of the table that knows its id, the column whose rate is its prior.
SHOP = (("item_id", "kind"), ("vendor_id", "nation_id"), ("client_id", "segment"))


def sale_rates(sale_lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, gap_seconds: int = 0, slice_events: int = SLICE_EVENTS) -> DataFrame:
    """Per sale_id, item_id and vendor_id: n_lines, n_returned of its own lines, and the history of
    its item, vendor and client: {item, vendor, client}_n and _rate."""
    lines = sale_lines.where("sale_id is not null").groupBy("sale_id", F.coalesce("item_id", F.lit(-1)).alias("item_id"), "vendor_id")
    lines = lines.agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "returned").alias("s"))
    sold = sales.where("sale_id is not null and sold_at is not null").select("sale_id", F.coalesce("client_id", F.lit(-1)).alias("client_id"), F.unix_micros(F.col("sold_at").cast("timestamp")).alias("at"))

    def known(table: DataFrame, id_: str, parent: str) -> DataFrame:
        # written, so that the join's exchange is its own and a frequent id can be split
        once = table.where(F.col(id_).isNotNull()).groupBy(F.col(id_).cast("long").alias(id_)).agg(F.min(parent).cast("string").alias(parent))
        return io.written(once, "history-known").hint("merge")

    (item, kind), (vendor, nation), (client, segment) = SHOP
    sold = sold.join(known(clients, client, segment), client, "left")
    rows = lines.join(sold.hint("merge"), "sale_id").join(known(items, item, kind), item, "left").join(known(vendors, vendor, nation), vendor, "left")
    rows = rows.select("sale_id", "item_id", "vendor_id", "client_id", kind, nation, segment, "at", fold_of(F.col("sale_id")).alias("fold"), "n", "s")
    found = history(rows, [c for pair in SHOP for c in pair], gap_seconds, FOLDS, slice_events, ["sale_id", "item_id", "vendor_id", "n", "s"])
    top = rate(F.lit(500_000).cast("long"), F.col("all_n"), F.col("all_s"))
    out = []
    for id_, parent in SHOP:
        prior = rate(top, F.col(f"{parent}_n"), F.col(f"{parent}_s"))
        name = id_.removesuffix("_id")
        out += [F.col(f"{id_}_n").alias(f"{name}_n"), rate(prior, F.col(f"{id_}_n"), F.col(f"{id_}_s")).alias(f"{name}_rate")]
    return found.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), *out)
