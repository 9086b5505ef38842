"""Shared folder, materialisation and table access for the training-data operators.

Executors can be lost at any time, so intermediate results are cut by writing them as Parquet to the folder named by
``spark.checkpoint.dir``, which the driver and all executors share. Task outputs that are plain files carry a unique
name and become visible only through the row that a successful attempt returns.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI; one of our own only in local mode, where driver and executors share a disk."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where if "://" in where or where.startswith("file:") else "file://" + where


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove)
    _MADE.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages never recompute what is above."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of fewer rows for the actions within: whole texts stand in memory a batch at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Up to so many rows of a few numbers each (some tens of MB), counted first, a table is broadcast.
BROADCAST_ROWS = 1_000_000


def broadcast_small(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it is small; else joined by shuffling."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def tasks_for(df: DataFrame, each: int = 64_000_000, most: int = 10_000, at_most_each: int = 512_000_000) -> int:
    """How many tasks to sort ``df`` in: by the size that Spark knows of its files, some per core at least.

    Beyond ``most`` tasks of ``each`` bytes tasks grow rather than their number, up to ``at_most_each``. Where no size is
    known (rows that are no file's) it is the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    least = 4 * spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(-(-size // each), max(most, -(-size // at_most_each))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_fs(uri: str):
    """(pyarrow file system, path) for a URI of the shared folder, on driver or executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:///", "/") if uri.startswith("file:///") else uri)
