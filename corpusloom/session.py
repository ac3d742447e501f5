"""Session defaults."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "corpusloom", **conf: str) -> SparkSession:
    """A session with the settings that the operators count on; `conf` overrides them."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it comes in fewer splits than half of them (a file of one row
    group is one split); tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Zoneless timestamps as timestamps, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is (shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def is_local(spark: SparkSession) -> bool:
    """Is there one machine alone? `local-cluster` has executors with folders of their own."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


_own_folder: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder, which all executors share; below a folder
    of this process only in local mode where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="corpusloom-"))
            atexit.register(shutil.rmtree, _own_folder[0], True)
        base = f"file://{_own_folder[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, kept: list[str] | None = None, **options: str) -> DataFrame:
    """df computed once, written (with a writer's options) to a work folder and read from there: cuts
    the lineage. With `kept` the folder's name is added to it, for `removed`."""
    path = work_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    if kept is not None:
        kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def removed(spark: SparkSession) -> Iterator[list[str]]:
    """A list of folders, which are removed in the end."""
    paths: list[str] = []
    try:
        yield paths
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Bytes of files that a task reads where rows take many times their bytes at rest (lists of terms, postings).
SPLIT = 16 << 20
_SPLIT_CONF = "spark.sql.files.maxPartitionBytes"


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """What runs within reads files in splits of SPLIT bytes at most."""
    before = spark.conf.get(_SPLIT_CONF)
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)) > SPLIT:
        spark.conf.set(_SPLIT_CONF, str(SPLIT))
    try:
        yield
    finally:
        spark.conf.set(_SPLIT_CONF, before)
