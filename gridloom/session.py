"""Spark session helper with the settings the engine is designed for."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "gridloom", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution on; shuffle partitions default to twice the cores."""
    n = os.cpu_count() or 4 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which driver and executors share; removed at exit.

    Where the setting is absent it is a folder of this machine, and that only in local mode.
    """
    from gridloom.sources import tiff

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="gridloom-")
    folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, path = tiff.file_system(folder)
    system.create_dir(path, recursive=True)
    atexit.register(lambda: system.delete_dir(path))
    return folder
