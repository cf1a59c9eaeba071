"""Spark session for local runs; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A UTC session on ``local[cpus]`` with AQE on and as many shuffle partitions as cores."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corploom")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores (one row group, say), dealt out to twice as many; others as they are.

    Partitions are counted without reading a column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
    return df if found is None or found + 1 >= cores else df.repartition(2 * cores)
