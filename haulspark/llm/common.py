"""What the operators of this subpackage share: tables that cut lineage, and row helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.sources.shipping import ship_package

_OWN_DIRS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a session in one local process gets a temporary folder; on a cluster, whose executors could
    not read what others wrote there, it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIRS[app]


class Scratch:
    """Tables of one operator run, as Parquet in the shared folder.

    A saved table replaces its lineage: a lost executor costs a reread, not a recomputation, and the rows no
    longer depend on how an earlier stage was scheduled. ``drop`` removes a table that no later plan reads;
    the rest goes when the driver's interpreter ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship_package(spark)
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.path)

    def _remove(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before the interpreter
            pass

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.path}/{name}")


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int):
    """Arrow batches of few rows, for jobs whose rows are whole blocks; the session's own setting returns afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; when a task ends its worker, which stays for other tasks, gives back the memory it no longer uses."""

    def lean_run(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # of the C library of Linux alone
                ctypes.CDLL(None).malloc_trim(0)

    return lean_run


def text_bytes(text: str = "text") -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return F.col(text).cast("binary")
