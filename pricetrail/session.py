"""Session settings the operators rely on, for local runs and for tests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "pricetrail") -> SparkSession:
    """A local session. On a cluster the submitter's settings are kept instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture per column call costs more than planning does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PRICETRAIL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Instants are UTC everywhere; local calendars are derived explicitly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def keep_compiled(spark: SparkSession) -> SparkSession:
    """Stages whose generated method the JVM would only interpret (above 8000 bytes) run operator by operator.

    Rules over a whole offer make such methods; an operator's own code is split into small ones.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    A folder of our own is used only in local mode, and goes when the process
    ends. Elsewhere executors would each write to their own disk and the table
    read back would lack their rows, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="pricetrail-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write a result that several plans are about to read, and read it back.

    The table goes to the shared folder, so it survives lost executors, and
    what reads it is planned and computed from the table alone.
    """
    path = f"{shared_folder(df.sparkSession)}/settled/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
