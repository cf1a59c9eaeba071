"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How many rows of a table an Arrow map gets at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN_DIRS: list[tempfile.TemporaryDirectory] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where none is set and all runs in one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIRS:
        _OWN_DIRS.append(tempfile.TemporaryDirectory(prefix="spark-corploom-", ignore_cleanup_errors=True))
        atexit.register(_OWN_DIRS[0].cleanup)
    return f"file://{_OWN_DIRS[0].name}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its store, as Spark would read it; other libraries take a bare path for a local one."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared scratch folder."""
    return f"{scratch_dir(spark)}/corploom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared scratch folder and read back.

    The readers of the result neither recompute it nor depend on an executor that may be lost.
    ``batch``: while it is written, Arrow maps get as many rows at once, or fewer if the session says so.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    if batch is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(batch, int(before)) if int(before) > 0 else batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)
