"""New audio files as a stream: each file is measured once, as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.operators import qc


def watch(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path, modificationTime, length, content) of files as they appear below root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)


def measured(stream: DataFrame) -> DataFrame:
    """QC rows of the stream; the utterance is the file's name."""
    none = [F.lit(None).cast("string").alias(c) for c in ("label", "split", "source_corpus")]
    return qc.measured(stream.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("utt_id"), "path", *none, "content"))
