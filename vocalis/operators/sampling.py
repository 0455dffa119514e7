"""Splits and samples that do not depend on partitioning: order comes from hashes of the ids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Speakers that a seeded permutation on the driver may put in order; with more the split is an error, never a part.
MAX_GROUPS = 1_000_000


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def validation_groups(groups: list[str], fraction: float, seed: int) -> list[str]:
    """The ceil(fraction * n) groups that a seeded permutation of the sorted ones puts first."""
    ordered = sorted(groups)
    return [ordered[i] for i in np.random.RandomState(seed).permutation(len(ordered))[: math.ceil(fraction * len(ordered))]]


def speaker_disjoint_split(manifest: DataFrame, fraction: float = 0.15, seed: int = 1337, source: str = "train", target: str = "val") -> DataFrame:
    """Move whole speakers of one split to another. The list of speakers alone comes to the driver, at most MAX_GROUPS."""
    if not 0 < fraction < 1:
        raise ValueError(f"fraction {fraction} is not between 0 and 1")
    speakers = [r[0] for r in manifest.where(F.col("split") == source).select("speaker").distinct().limit(MAX_GROUPS + 1).collect()]
    if len(speakers) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} speakers")
    if not speakers:
        raise ValueError(f"no rows of split {source!r}")
    if len(speakers) < 2:
        raise ValueError("fewer than two speakers")
    spark = manifest.sparkSession
    moved = spark.createDataFrame([(s,) for s in validation_groups(speakers, fraction, seed)], "speaker string").withColumn("_moved", F.lit(True))
    joined = manifest.join(F.broadcast(moved) if len(speakers) < 100_000 else moved, "speaker", "left")
    return joined.withColumn("split", F.when((F.col("split") == source) & F.col("_moved"), target).otherwise(F.col("split"))).select(*manifest.columns)


def sample_per_split(manifest: DataFrame, max_files: int, seed: int = 1337, key: str = "utt_id") -> DataFrame:
    """All rows up to max_files; else the same number from each split, in hash order, unused places lost."""
    sizes = manifest.groupBy("split").count().collect()
    if sum(r["count"] for r in sizes) <= max_files:
        return manifest
    quota = max(1, max_files // max(1, len(sizes)))
    place = F.row_number().over(Window.partitionBy("split").orderBy(hash_order(key, seed), key))
    return manifest.withColumn("_place", place).where(F.col("_place") <= quota).drop("_place")


def first_in_order(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The n rows that come first in hash order, n being any share of a large table.

    Rows are counted by the first four digits of their hash; those below the digits that hold the n-th row
    stay whole, and only the rows of these digits are ranked.
    """
    placed = df.withColumn("_hash", hash_order(key, seed)).withColumn("_head", F.substring("_hash", 1, 4))
    left, cut = n, None
    for r in placed.groupBy("_head").count().orderBy("_head").collect():
        if r["count"] >= left:
            cut = r["_head"]
            break
        left -= r["count"]
    if cut is None:
        return df
    last = placed.where(F.col("_head") == cut).withColumn("_place", F.row_number().over(Window.partitionBy("_head").orderBy("_hash", key))).where(F.col("_place") <= left)
    return placed.where(F.col("_head") < cut).unionByName(last.drop("_place")).drop("_hash", "_head")


def balanced(manifest: DataFrame, seed: int = 1337, key: str = "utt_id", shuffled: bool = True) -> DataFrame:
    """All bonafide rows and as many spoof ones in hash order, in one hash order if shuffled."""
    sizes = {r["label"]: r["count"] for r in manifest.groupBy("label").count().collect()}
    n = sizes.get("bonafide", 0)
    if sizes.get("spoof", 0) < n:
        raise ValueError("fewer spoof than bonafide rows")
    spoof = first_in_order(manifest.where("label = 'spoof'"), n, seed, key)
    out = manifest.where("label = 'bonafide'").unionByName(spoof)
    return out.orderBy(hash_order(key, seed + 1), key) if shuffled else out
