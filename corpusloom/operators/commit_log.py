"""Tables behind a log of numbered commits.

Below its root a `Store` has `log/` with an entry for each version and `data/` with what the entries
name. An entry is written beside and renamed to its number, which fails if that is there already;
so a commit is one rename, of all the tables it changes together, and a version never changes. A
reader takes the newest entry, and keeps seeing the files that it names. What a writer leaves that
stops before its rename is never named; `vacuum` takes it away. A store without entries, or with a
gap among them, is an error, never an empty table.

Two kinds of tables:

* keyed ones lie in buckets by the low bits of a hash of their keys. A bucket is (depth, residue):
  rows whose lowest `depth` bits are `residue`. A merge reads and writes the buckets alone that its
  rows fall into, and one that has grown beyond `most_rows` goes on as two of a bit more. Depths and
  residues stand in the log, so no caller can get them wrong.
* appended ones are lists of parts; a commit adds parts or takes the place of them all.

A commit that another one has overtaken is applied again to the newer version. The file system has
to refuse a rename onto what is there, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed

_DIGITS = 20
#: Buckets of a new keyed table, as a power of two, and rows beyond which a bucket is split.
DEPTH, MOST_ROWS = 3, 2_000_000
#: Buckets that the tasks of a merge write to without dealing their rows, each a file in every one of them.
DIRECT = 64
#: Of the old rows of the buckets concerned and the new ones: their rows from now on.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class StoreError(RuntimeError):
    pass


class Conflict(StoreError):
    """Another writer has taken the version."""


@dataclass(frozen=True)
class Leaf:
    depth: int
    residue: int
    folder: str | None
    rows: int = 0

    @property
    def name(self) -> str:
        return f"{self.depth}-{self.residue}"


@dataclass(frozen=True)
class Table:
    schema: str
    keys: tuple[str, ...] = ()
    leaves: tuple[Leaf, ...] = ()
    parts: tuple[str, ...] = ()
    by: tuple[str, ...] = ()

    @property
    def folders(self) -> list[str]:
        return [*self.parts, *(f"{x.folder}/_leaf={x.name}" for x in self.leaves if x.folder)]


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, Table] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"tables": {n: {"schema": t.schema, "keys": t.keys, "parts": t.parts, "by": t.by, "leaves": [(x.depth, x.residue, x.folder, x.rows) for x in t.leaves]} for n, t in self.tables.items()}, "done": self.done})

    @classmethod
    def of(cls, number: int, text: str) -> Version:
        raw = json.loads(text)
        tables = {n: Table(t["schema"], tuple(t["keys"]), tuple(Leaf(*x) for x in t["leaves"]), tuple(t["parts"]), tuple(t["by"])) for n, t in raw["tables"].items()}
        return cls(number, tables, raw["done"])


class _Files:
    """The few calls of Hadoop's file systems that a log needs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, milliseconds of its last change) of what lies in a folder."""
        at = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_new(self, old: str, new: str) -> None:
        options = self.gateway.new_array(self.hadoop.fs.Options.Rename, 1)
        options[0] = self.hadoop.fs.Options.Rename.NONE
        try:
            self.hadoop.fs.FileContext.getFileContext(self.path(new).toUri(), self.conf).rename(self.path(old), self.path(new), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(new) from None
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Store:
        """A new store; one that is there already, or data without its log, is an error."""
        store = cls(spark, root)
        if store.files.names(f"{store.root}/data") and not store._numbers():
            raise StoreError(f"{root} has data but no log")
        try:
            store._put(Version(0))
        except Conflict:
            raise StoreError(f"there is a store at {root} already") from None
        return store

    @classmethod
    def ensure(cls, spark: SparkSession, root: str) -> Store:
        """The store at root, a new one if nothing at all is there."""
        store = cls(spark, root)
        return store if store._numbers() else cls.create(spark, root)

    # -- versions ----------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self.files.names(f"{self.root}/log") if n.endswith(".json") and not n.startswith("."))

    def _entry(self, number: int) -> str:
        return f"{self.root}/log/{number:0{_DIGITS}d}.json"

    def _put(self, version: Version) -> None:
        beside = f"{self.root}/log/.{uuid.uuid4().hex}"
        self.files.write(beside, version.text())
        try:
            self.files.rename_new(beside, self._entry(version.number))
        except Conflict:
            self.files.delete(beside)
            raise

    def version(self, number: int | None = None) -> Version:
        """A version, the newest by default."""
        numbers = self._numbers()
        if not numbers:
            raise StoreError(f"no log at {self.root}")
        if numbers != list(range(numbers[0], numbers[-1] + 1)):
            raise StoreError(f"entries are missing in the log at {self.root}")
        number = numbers[-1] if number is None else number
        if number not in numbers:
            raise StoreError(f"no version {number} at {self.root}")
        return Version.of(number, self.files.read(self._entry(number)))

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a version; a name that it doesn't have is an error."""
        version = self.version(number)
        if name not in version.tables:
            raise StoreError(f"no table {name!r} at {self.root}")
        return self._read(name, version.tables[name], version.tables[name].folders)

    def _read(self, name: str, table: Table, folders: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(table.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{name}").parquet(*[f"{self.root}/data/{f}" for f in folders])
        return found.select(*[f"`{c}`" for c in schema.names])

    def read_near(self, name: str, rows: DataFrame, number: int | None = None) -> DataFrame:
        """Rows of the buckets of a keyed table that the keys of `rows` fall into, no others are read."""
        table = self.version(number).tables[name]
        touched = self._touched(table, rows.select(F.xxhash64(*table.keys).alias("_hash")))
        return self._read(name, table, [f"{x.folder}/_leaf={x.name}" for x in touched if x.folder])

    # -- changes -----------------------------------------------------------------------------

    def add_keyed(self, name: str, schema: StructType, keys: Sequence[str], depth: int = DEPTH) -> None:
        """A new empty keyed table; the same one again changes nothing."""
        leaves = tuple(Leaf(depth, r, None) for r in range(1 << depth))
        self._add(name, Table(schema.json(), tuple(keys), leaves))

    def add_appended(self, name: str, schema: StructType, by: Sequence[str] = ()) -> None:
        """A new empty table of parts, each with a folder for every value of `by`."""
        self._add(name, Table(schema.json(), by=tuple(by)))

    def _add(self, name: str, table: Table) -> None:
        def change(version: Version) -> dict[str, Table]:
            have = version.tables.get(name)
            if have and (json.loads(have.schema), have.keys, have.by) != (json.loads(table.schema), table.keys, table.by):
                raise StoreError(f"table {name!r} has other columns or keys")
            return {} if have else {name: table}

        self._commit(change)

    def _commit(self, change: Callable[[Version], dict[str, Table]], txn: tuple[str, int] | None = None, tries: int = 20) -> Version:
        for _ in range(tries):
            now = self.version()
            if txn and now.done.get(txn[0], -1) >= txn[1]:
                return now
            tables = {n: t for n, t in change(now).items() if t != now.tables.get(n)}
            if not tables and not txn:
                return now
            new = Version(now.number + 1, {**now.tables, **tables}, {**now.done, **({txn[0]: txn[1]} if txn else {})})
            try:
                self._put(new)
                return new
            except Conflict:
                continue
        raise StoreError(f"others keep committing at {self.root}")

    def commit(self, merges: dict[str, tuple[DataFrame, Merge]] | None = None, appends: dict[str, DataFrame] | None = None, replaces: dict[str, DataFrame] | None = None, txn: tuple[str, int] | None = None, most_rows: int = MOST_ROWS, after: int | None = None, at_rest: Sequence[str] = (), options: dict[str, str] | None = None) -> Version:
        """All of these in one version: `merges` bring new rows into keyed tables (merge is given the old
        rows of the buckets that the new ones fall into, and these), `appends` add a part to appended tables,
        `replaces` take the place of all their parts. A txn (writer, number) that isn't above the
        writer's last one changes nothing, so a batch can be run again. With `after` it is a Conflict
        if the newest version isn't that one any more. Rows of the merges named by `at_rest` are read from
        files that stay, so they needn't be written to be the same each time. `options` are those of the writer."""
        if txn and self.version().done.get(txn[0], -1) >= txn[1]:
            return self.version()
        # what doesn't depend on the version is written once, whoever overtakes
        parts = {n: self._part(n, df, options or {}) for n, df in {**(appends or {}), **(replaces or {})}.items()}
        new = {n: (self._hashed(df, self.version().tables[n].keys, n in at_rest), merge) for n, (df, merge) in (merges or {}).items()}
        merged: dict[str, tuple[Table, Table]] = {}

        def change(version: Version) -> dict[str, Table]:
            if after is not None and version.number != after:
                raise Conflict(f"version {version.number} came after {after}")
            out = {}
            for n, part in parts.items():
                if version.tables[n].keys:
                    raise StoreError(f"table {n!r} is keyed")
                out[n] = replace(version.tables[n], parts=(part,) if n in (replaces or {}) else (*version.tables[n].parts, part))
            for n, (rows, merge) in new.items():
                if n not in merged or merged[n][0] != version.tables[n]:
                    merged[n] = version.tables[n], self._merged(n, version.tables[n], rows, merge, most_rows, options or {})
                out[n] = merged[n][1]
            return out

        return self._commit(change, txn)

    def _part(self, name: str, rows: DataFrame, options: dict[str, str]) -> str:
        part = f"{name}/_part={uuid.uuid4().hex}"
        by = self.version().tables[name].by
        writer = rows.write.partitionBy(*by) if by else rows.write
        writer.options(**options).parquet(f"{self.root}/data/{part}")
        return part

    def _hashed(self, rows: DataFrame, keys: Sequence[str], at_rest: bool) -> DataFrame:
        """New rows, computed once, with the hash that their bucket is told by."""
        hashed = rows.withColumn("_hash", F.xxhash64(*keys))
        return hashed if at_rest else checkpointed(hashed)

    def _leaf_of(self, leaves: Sequence[Leaf]) -> tuple[DataFrame, Column]:
        """A row for each slot of the deepest level with the name of its leaf, and a row's slot."""
        depth = max(x.depth for x in leaves)
        slots = [(r, x.name) for x in leaves for r in range(x.residue, 1 << depth, 1 << x.depth)]
        return F.broadcast(self.spark.createDataFrame(slots, "_slot long, _leaf string")), F.col("_hash").bitwiseAND(F.lit((1 << depth) - 1))

    def _touched(self, table: Table, hashed: DataFrame) -> list[Leaf]:
        """The buckets that rows with a _hash fall into; at most all of them pass the driver."""
        slots, slot = self._leaf_of(table.leaves)
        names = {r[0] for r in hashed.select(slot.alias("_slot")).distinct().join(slots, "_slot").select("_leaf").distinct().collect()}
        return [x for x in table.leaves if x.name in names]

    def _merged(self, name: str, table: Table, new: DataFrame, merge: Merge, most_rows: int, options: dict[str, str]) -> Table:
        old = self._touched(table, new)
        if not old:
            return table
        touched = {x.name for x in old}
        columns = StructType.fromJson(json.loads(table.schema)).names
        rows = merge(self._read(name, table, [f"{x.folder}/_leaf={x.name}" for x in old if x.folder]), new.select(*columns))
        # buckets that have grown go on as two
        own = [y for x in old for y in ([x] if x.rows <= most_rows else [Leaf(x.depth + 1, x.residue + b * (1 << x.depth), None) for b in (0, 1)])]
        slots, slot = self._leaf_of([*own, *(x for x in table.leaves if x.name not in touched)])
        part = f"{name}/_part={uuid.uuid4().hex}"
        placed = rows.select(*columns).withColumn("_hash", F.xxhash64(*table.keys)).withColumn("_slot", slot).join(slots, "_slot").select(*columns, "_leaf")
        if len(own) > DIRECT:  # tasks of one bucket each, several of them where it is large
            placed = placed.hint("rebalance", "_leaf")
        placed.write.partitionBy("_leaf").options(**options).parquet(f"{self.root}/data/{part}")
        counts = {}
        if self.files.names(f"{self.root}/data/{part}"):
            written = self.spark.read.schema(StructType.fromJson(json.loads(table.schema)).add("_leaf", "string")).parquet(f"{self.root}/data/{part}")
            counts = {r[0]: r[1] for r in written.groupBy("_leaf").count().collect()}
        now = [Leaf(y.depth, y.residue, part if y.name in counts else None, counts.get(y.name, 0)) for y in own]
        return replace(table, leaves=tuple(sorted([*(x for x in table.leaves if x.name not in touched), *now], key=lambda x: (x.residue, x.depth))))

    def vacuum(self, keep: int = 10, older_s: float = 86_400.0) -> int:
        """Removes entries but for the last `keep`, and data that no entry left names and that is
        older than older_s (younger may be of a commit under way); the number of folders removed."""
        numbers, before = self._numbers(), (time.time() - older_s) * 1000
        named = {f.split("/_leaf=")[0] for n in numbers[-keep:] for t in self.version(n).tables.values() for f in t.folders}
        for n in numbers[:-keep]:  # the oldest first, so that what is left has no gap
            self.files.delete(self._entry(n))
        gone = 0
        for name, _ in self.files.names(f"{self.root}/data"):
            for part, changed in self.files.names(f"{self.root}/data/{name}"):
                if f"{name}/{part}" not in named and changed < before:
                    self.files.delete(f"{self.root}/data/{name}/{part}")
                    gone += 1
        for name, changed in self.files.names(f"{self.root}/log"):
            if name.startswith(".") and changed < before:
                self.files.delete(f"{self.root}/log/{name}")
        return gone
