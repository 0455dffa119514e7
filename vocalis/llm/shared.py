"""Tables in the folder that all executors share, and connected components over links."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Caches of this Python worker, by the operator that fills them.
_CACHES: dict[str, Callable[[], None]] = {}


def cache_of(name: str, clear: Callable[[], None]) -> None:
    """Called where an operator's work on a partition begins: what other operators hold in this worker is given back."""
    others = [x for x in _CACHES if x != name]
    for other in others:
        _CACHES.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        # Of the C libraries, glibc can be told to return what it keeps between blocks in use.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    _CACHES[name] = clear


#: Used by a session on this machine alone that names no folder, as in tests.
_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="vocalis-"))
    return _OWN[0]


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _at(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written(), with the rows of a key in one bucket in order: joins on the key do not move them again."""
    spark = df.sparkSession
    path, table = f"{folder(spark)}/{name}-{uuid.uuid4().hex}", f"vocalis_{name}_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    where, files = _at(spark, path)
    files.deleteOnExit(where)
    out = spark.table(table)
    out._written_at, out._table = path, table
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() and bucketed() that nothing reads any more."""
    for t in tables:
        if "_table" in t.__dict__:
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._table}")
        where, files = _at(t.sparkSession, t._written_at)
        files.delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of past plans, which it does when the driver's JVM finds that nothing refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The size of the files of a table of written() or bucketed(); nothing is read."""
    where, files = _at(df.sparkSession, df._written_at)
    return int(files.getContentSummary(where).getLength())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for nodes that have a link.

    Rounds of minimum labels with pointer jumping, each round's labels written to the shared folder; the
    number of rounds is about the logarithm of the longest chain. No links give no rows.
    """
    edges = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).where("x <> y").distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        # The smallest label among a node and its neighbours, then the label of that label.
        near = edges.join(labels, edges.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(near, "node").select("node", F.least("component", "m").alias("low"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        step = written(low.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("component"), "was"), "labels")
        drop(labels)
        labels = step
        if step.where("component <> was").isEmpty():
            drop(edges)
            return labels.select("node", "component")
