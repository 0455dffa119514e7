"""The 92-column feature table: decoding, pre-processing and features in one pass, waveforms never shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.functions import kernels
from vocalis.schemas import FEATURE_META, FEATURES, MANIFEST

SCHEMA = T.StructType([*(MANIFEST[c] for c in FEATURE_META), *(T.StructField(c, T.DoubleType()) for c in FEATURES), T.StructField("error", T.StringType())])


def _table(meta: pd.DataFrame, vectors: list[np.ndarray | None], errors: list[str | None]) -> pd.DataFrame:
    values = np.array([np.full(len(FEATURES), np.nan) if v is None else v for v in vectors]).reshape(-1, len(FEATURES))
    return pd.concat([meta.reset_index(drop=True), pd.DataFrame(values, columns=list(FEATURES)), pd.Series(errors, name="error", dtype=object)], axis=1)


def extract(manifest: DataFrame, files: DataFrame, length: int = 64000, crop_seed: int | None = None) -> DataFrame:
    """Feature rows with `error`: null for good rows, else the reason and no features. files: (path, content). With crop_seed long signals are cropped at random."""
    joined = manifest.join(files.select("path", "content"), "path", "left").select(*FEATURE_META, "path", "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from vocalis.sources.audio import load

        for p in parts:
            vectors, errors = [], []
            for content, path, utt in zip(p["content"], p["path"], p["utt_id"], strict=True):
                try:
                    if content is None:
                        raise RuntimeError(f"no such file: {path}")
                    # A random crop depends on the seed and the utterance alone.
                    rng = None if crop_seed is None else np.random.default_rng([crop_seed, zlib.crc32(str(utt).encode())])
                    vectors.append(kernels.feature_vector(kernels.preprocess(load(content, path), length, rng=rng)))
                    errors.append(None)
                except (RuntimeError, ValueError) as e:
                    vectors.append(None)
                    errors.append(str(e))
            yield _table(p[list(FEATURE_META)], vectors, errors)

    return joined.mapInPandas(rows, SCHEMA)


def progress(features: DataFrame) -> DataFrame:
    """One row: n_processed and n_total."""
    return features.agg(F.count_if(F.col("error").isNull()).alias("n_processed"), F.count("*").alias("n_total"))


def good(features: DataFrame) -> DataFrame:
    return features.where("error IS NULL").drop("error")


def from_samples(df: DataFrame, id_col: str, samples_col: str, rate: int = kernels.RATE) -> DataFrame:
    """(id, 92 features) of array columns; null or empty signals give null features."""
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, T.DoubleType()) for c in FEATURES)])

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            vectors = [np.full(len(FEATURES), np.nan) if x is None or not len(x) else kernels.feature_vector(np.asarray(x, np.float64), rate) for x in p[samples_col]]
            yield pd.concat([p[[id_col]].reset_index(drop=True), pd.DataFrame(np.array(vectors).reshape(-1, len(FEATURES)), columns=list(FEATURES))], axis=1)

    out = df.select(id_col, samples_col).mapInPandas(rows, schema)
    return out.select(id_col, *(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in FEATURES))
