"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; one of our own only where that is unset and the master is local, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="cairnfield-")
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/cairnfield/{tag}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, as whole documents stand in them; smaller ones stay."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


#: Caches that workers hold from task to task, by the kind of task that uses them.
CACHES: dict[str, dict] = {}


def lean(run: Callable, keeps: str = "") -> Callable:
    """A function for mapInArrow that clears other kinds' caches before a task and gives freed memory back after it, as workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, cache in CACHES.items():
            if kind != keeps:
                cache.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return wrapped


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library, without such a call
        pass


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed on leaving, but for those written with `outer`."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop(spark, path)


def materialise(df: DataFrame, tag: str, *, outer: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage and survives lost executors.

    The table belongs to the innermost scope, or with `outer` to the one around it; outside of all scopes it stays.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, tag)
    owner = len(_scopes) - 1 - outer
    if owner >= 0:
        _scopes[owner].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table of ours."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
