"""A drop directory as a stream: each file that arrives is planned and converted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import layout
from gridloom.sources import sidecar

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, directory: str, per_trigger: int = 100) -> DataFrame:
    """Paths of raster files as they arrive; contents are pruned away."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", per_trigger).load(directory)
    return files.select("path", "modificationTime").where(F.lower("path").rlike(r"\.(" + "|".join(sidecar.EXTENSIONS) + ")$"))


def convert_arrivals(spark: SparkSession, directory: str, checkpoint: str, job: Callable[[str, str], None], results: str, **trigger) -> StreamingQuery:
    """Run ``job(path, output)`` for each arrival; a row per file (status, error, seconds) is appended to ``results``.

    A batch that runs again after a failure writes the same outputs: names follow from inputs.
    """

    def batch(df: DataFrame, n: int) -> None:
        none = spark.createDataFrame([], "output string")
        done = layout.run_batch(layout.batch_plan(df, none), job)
        done.withColumn("batch", F.lit(n)).write.mode("append").parquet(results)

    return arrivals(spark, directory).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
