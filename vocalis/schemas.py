"""Fixed schemas and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The manifest: one row an utterance. spoof is the positive class (1), bonafide 0.
MANIFEST = T.StructType([T.StructField(c, T.LongType() if c == "label_id" else T.StringType()) for c in ("utt_id", "path", "label", "label_id", "speaker", "attack", "source_corpus", "split")])
LABEL_IDS = {"bonafide": 0, "spoof": 1}
UNKNOWN_SPEAKER, NO_ATTACK = "unknown", "bonafide"

_QC_TEXT = ("utt_id", "path", "label", "split", "source_corpus")
QC = T.StructType([*(T.StructField(c, T.StringType()) for c in _QC_TEXT), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("n_channels", T.IntegerType()), T.StructField("n_samples", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("duration_s", "dc_offset", "rms", "rms_dbfs", "peak", "clipping_rate", "silence_ratio"))])

FEATURE_BASES = (*(f"mfcc_{i:02d}" for i in range(1, 21)), *(f"lfcc_{i:02d}" for i in range(1, 21)), "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flux", "short_time_energy", "zero_crossing_rate")
FEATURES = tuple(f"{b}_{s}" for s in ("mean", "std") for b in FEATURE_BASES)
FEATURE_META = ("utt_id", "label", "label_id", "speaker", "attack", "source_corpus", "split")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def feature_set(name: str) -> list[str]:
    """Columns of one of the four feature families, in canonical order."""
    prefixes = {"MFCC": ("mfcc_",), "LFCC": ("lfcc_",), "MFCC+Spectral": ("mfcc_", "spectral_", "short_time", "zero_"), "Combined": ("",)}[name]
    return [c for c in FEATURES if c.startswith(prefixes)]
