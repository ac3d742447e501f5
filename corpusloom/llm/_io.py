"""Tables, shared folders and exchanges used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import is_local

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode only, as in tests, a folder of this process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="corpusloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it again; cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _scopes[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def dropping(spark: SparkSession) -> Iterator[list[str]]:
    """Removes what `written` writes within, the paths that this gives, when it ends."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Bytes of a batch that goes to a Python worker. Spark's own limit of 64 MB is held several times
#: over by the JVM and the worker.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow; the session's batches are limited to BATCH_BYTES, if they aren't smaller yet."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_CONF, "64m").lower().removesuffix("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    now_bytes = int(now.rstrip("kmg")) * scale
    if not 0 < now_bytes <= BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets(spark: SparkSession) -> int:
    """Buckets of a hashed exchange: several to a partition, so that none of them weighs much."""
    return max(64, 4 * shuffle_partitions(spark))


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, row numbers in their order) for each bucket that has rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for rows in np.split(order, cuts):
        yield int(bucket[rows[0]]), rows


def with_text_of(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows of `docs` whose doc_id is in `ids` (one column doc_id, distinct).

    Up to `most` ids (8 bytes each) are counted first and broadcast, so that other texts are
    never shuffled; beyond, it is a shuffled semi join.
    """
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def batches(table_: pa.Table, most: int = 4096) -> Iterator[pa.RecordBatch]:
    yield from table_.to_batches(max_chunksize=most)
