"""Signal quality: measures of each file, summaries and histogram data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.functions import kernels
from vocalis.schemas import QC


def measure(content: bytes | None, path: str, clipping: float = 0.99, top_db: float = 30.0) -> dict:
    """The measured part of a QC row; a failure is a row with ok false and its text."""
    from vocalis.sources.audio import decode

    out: dict = {c: None for c in QC.names[5:]} | {"ok": False, "error": ""}
    try:
        if content is None:
            raise RuntimeError(f"no such file: {path}")
        x, rate = decode(content, path)
        mono = x.mean(0).astype(np.float64)
        if not len(mono):
            raise RuntimeError(f"no samples in {path}")
    except RuntimeError as e:
        return out | {"error": str(e)}
    rms = float(np.sqrt((mono**2).mean()))
    return out | {"ok": True, "sample_rate": rate, "n_channels": len(x), "n_samples": len(mono), "duration_s": len(mono) / rate, "dc_offset": float(mono.mean()), "rms": rms, "rms_dbfs": 20 * float(np.log10(rms)) if rms > 1e-12 else -120.0, "peak": float(np.abs(mono).max()), "clipping_rate": float((np.abs(mono) >= clipping).mean()), "silence_ratio": kernels.silence_ratio(mono, top_db)}


def run(manifest: DataFrame, files: DataFrame, clipping: float = 0.99, top_db: float = 30.0) -> DataFrame:
    """One QC row an utterance. files: (path, content); a path without file is a failed row."""
    joined = manifest.select("utt_id", "path", "label", "split", "source_corpus").join(files.select("path", "content"), "path", "left")
    return measured(joined, clipping, top_db)


def measured(contents: DataFrame, clipping: float = 0.99, top_db: float = 30.0) -> DataFrame:
    """QC rows of (utt_id, path, label, split, source_corpus, content), bounded or a stream."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            done = pd.DataFrame([measure(c, f, clipping, top_db) for c, f in zip(p["content"], p["path"], strict=True)], columns=QC.names[5:])
            yield pd.concat([p.drop(columns="content").reset_index(drop=True), done], axis=1)[QC.names]

    return contents.select("utt_id", "path", "label", "split", "source_corpus", "content").mapInPandas(rows, QC)


def summarize(qc: DataFrame) -> DataFrame:
    """By split and label; statistics over readable files alone, null where there are none; rates in order as text."""
    ok = F.col("ok")

    def over(c: str):
        return F.when(ok, F.col(c))

    rates = F.array_join(F.array_sort(F.collect_set(over("sample_rate").cast("string"))), ",")
    return qc.where("split IS NOT NULL AND label IS NOT NULL").groupBy("split", "label").agg(
        F.count("*").alias("n_files"), F.count_if(~ok).alias("n_corrupt"), F.when(rates == "", "-").otherwise(rates).alias("sample_rates"),
        F.round(F.avg(over("duration_s")), 3).alias("dur_mean_s"), F.round(F.median(over("duration_s")), 3).alias("dur_median_s"), F.round(F.min(over("duration_s")), 3).alias("dur_min_s"), F.round(F.max(over("duration_s")), 3).alias("dur_max_s"),
        F.round(F.avg(over("rms_dbfs")), 2).alias("rms_dbfs_mean"), F.round(F.avg(over("peak")), 4).alias("peak_mean"), F.avg(over("dc_offset")).alias("dc_offset_mean"), F.max(F.abs(over("dc_offset"))).alias("dc_offset_absmax"),
        F.avg(over("clipping_rate")).alias("clipping_rate_mean"), F.round(F.avg(over("silence_ratio")), 4).alias("silence_ratio_mean"),
    )


#: A colour for each class in figures, and for anything else.
CLASS_COLOURS, OTHER_COLOUR = {"bonafide": "#0072B2", "spoof": "#D55E00"}, "#666666"


def class_colour(label: str) -> str:
    return CLASS_COLOURS.get(label, OTHER_COLOUR)


def write(qc: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """The sinks of a quality run: measures, their summary, and the data of its figures."""
    base = folder.rstrip("/")
    for name, df in {"per_file": qc, "summary": summarize(qc), **figures(qc)}.items():
        out = df.write.mode("overwrite")
        (out.option("header", True).csv if fmt == "csv" else out.parquet)(f"{base}/{name}")


def figures(qc: DataFrame) -> dict[str, DataFrame]:
    """What the figures show: durations and levels of readable files by label, and files by split and label."""
    ok = qc.where("ok")
    return {"durations": histogram(ok, "duration_s", 40), "levels": histogram(ok, "rms_dbfs", 40), "balance": qc.groupBy("split", "label").agg(F.count("*").alias("n"))}


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None, by: str = "label") -> DataFrame:
    """(by, bin, n) of equal bins, the last one closed; limits default to the column's own."""
    if low is None or high is None:
        limits = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
        df = df.join(F.broadcast(limits))
        lo, hi = F.col("_low"), F.col("_high")
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    place = F.least(F.floor(F.coalesce(F.try_divide((F.col(column) - lo) * bins, hi - lo), F.lit(0.0))), F.lit(bins - 1))
    inside = F.col(column).between(lo, hi)
    return df.where(inside).groupBy(by, place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
