"""Session helpers shared by the queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: What a Python worker's allocators keep for themselves, for executors of little memory.
_ALLOCATORS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}
#: Arrow batches between the JVM and Python workers: setting, Spark's default, ours.
_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started, and get batches of whole texts that fit small executors.

    Settings that the session has changed from Spark's defaults stay.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for name, value in _ALLOCATORS.items():
        env.setdefault(name, value)
    for name, default, ours in _BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a scale-factor directory."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
