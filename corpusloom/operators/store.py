"""Keyed tables: upserts, patches, deletes, change sets. A mutation gives the new table as a
DataFrame; `commit_log` keeps tables at rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is last by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT OR REPLACE: rows of `new` (one a key) take the place of those with their keys."""
    return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_missing(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT OR IGNORE: rows of `new` (one a key) whose key isn't there yet."""
    return table.unionByName(new.join(table.select(*keys), list(keys), "left_anti"))


def patched(table: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UPDATE: columns of `patch` that aren't null replace those of the rows with its keys."""
    own = [c for c in patch.columns if c not in keys]
    found = table.join(patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in own]), list(keys), "left")
    return found.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in table.columns])


def delete(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """DELETE by filter; rows for which it is null stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def cascade(parents: DataFrame, children: Sequence[DataFrame], gone: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """Parents and each table of children without the rows of the keys that go."""
    return [delete(t, gone, keys) for t in (parents, *children)]


def cache_misses(texts: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache lacks."""
    return texts.select(key).distinct().join(cache.select(key), key, "left_anti")


def change_set(known: DataFrame, current: DataFrame, path: str = "relpath", content: str = "content_hash") -> DataFrame:
    """path, change ('added', 'modified', 'deleted')."""
    a = known.select(path, F.col(content).alias("_was"), F.lit(True).alias("_a"))
    b = current.select(path, F.col(content).alias("_is"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_was").eqNullSafe(F.col("_is")), "modified")
    return a.join(b, path, "full_outer").select(path, change.alias("change")).where("change is not null")


def page(rows: DataFrame, order: Sequence[str], after: Sequence | None, n: int) -> DataFrame:
    """The next n rows behind the keys `after`, by `order` (keyset pagination)."""
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)]))
    return rows.orderBy(*order).limit(n)


def newest(rows: DataFrame, n: int, order: str = "created_at", key: str = "id") -> DataFrame:
    """Newest first; between 1 and 500 rows."""
    return rows.orderBy(F.desc(order), F.desc(key)).limit(min(500, max(1, n)))
