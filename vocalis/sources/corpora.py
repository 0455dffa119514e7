"""Manifests of the known corpora, from a configuration's paths. What is absent is warned of and gives no rows."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.config import Config
from vocalis.operators.manifest import concat
from vocalis.schemas import MANIFEST
from vocalis.sources import protocol

# The layout of the 2019 release.
PROTOCOLS_2019 = "ASVspoof2019_LA_cm_protocols"
PROTOCOL_2019 = {"train": "ASVspoof2019.LA.cm.train.trn.txt", "dev": "ASVspoof2019.LA.cm.dev.trl.txt", "eval": "ASVspoof2019.LA.cm.eval.trl.txt"}
METADATA_2021 = "trial_metadata.txt"
AUDIO_DIRECTORIES = ("flac", "wav")


def _stat(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(where) if files.exists(where) else None


def is_dir(spark: SparkSession, path: str) -> bool:
    s = _stat(spark, path)
    return s is not None and s.isDirectory()


def is_file(spark: SparkSession, path: str) -> bool:
    s = _stat(spark, path)
    return s is not None and s.isFile()


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)


def _union(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    return concat(frames) if frames else empty_manifest(spark)


def find_audio_dir(spark: SparkSession, root: str, extension: str = ".flac") -> str:
    """root if it holds such files itself; else the directory below it that does: flac or wav by name first, then the shallowest, then by path."""
    if not is_dir(spark, root):
        raise FileNotFoundError(f"no such corpus directory: {root}")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    low = F.lower(F.element_at(F.split("dir", "/"), -1))
    found = protocol.list_audio(spark, root, extension).select(parent.alias("dir")).distinct()
    here = root.rstrip("/")
    best = found.orderBy((F.col("dir") != here), ~low.isin(*AUDIO_DIRECTORIES), F.size(F.split("dir", "/")), "dir").first()
    if best is None:
        raise FileNotFoundError(f"no directory with *{extension} files below {root}")
    return best.dir


def from_protocol_file(spark: SparkSession, protocol_path: str, audio_dir: str, source_corpus: str, split: str, project_root: str = "", extension: str = ".flac", require_audio: bool = True) -> DataFrame:
    """Manifest rows of a listing; with require_audio those without a file go, and how many is warned of."""
    if not is_file(spark, protocol_path):
        raise FileNotFoundError(f"no such protocol: {protocol_path}")
    rows = protocol.read_protocol(spark, protocol_path)
    if not require_audio:
        return protocol.from_protocol(rows, audio_dir, source_corpus, split, None, project_root, extension)
    files = protocol.list_audio(spark, audio_dir, extension)
    wanted = rows.select(F.concat(F.lit(audio_dir.rstrip("/") + "/"), "utt_id", F.lit(extension)).alias("path"))
    missing = wanted.join(files, "path", "left_anti").count()
    if missing:
        warnings.warn(f"{source_corpus}/{split}: {missing} files of the protocol are not in {audio_dir}; their rows are left out", stacklevel=2)
    return protocol.from_protocol(rows, audio_dir, source_corpus, split, files, project_root, extension)


def logical_access_2019(spark: SparkSession, config: Config, splits: tuple[str, ...] = ("train", "dev", "eval")) -> DataFrame:
    """The wanted partitions of the 2019 corpus; each needs its protocol and its audio."""
    root = config.path("asvspoof2019_la")
    if not is_dir(spark, root):
        warnings.warn(f"no 2019 corpus at {root}", stacklevel=2)
        return empty_manifest(spark)
    out = []
    for split in splits:
        listing, audio = os.path.join(root, PROTOCOLS_2019, PROTOCOL_2019[split]), os.path.join(root, f"ASVspoof2019_LA_{split}")
        if is_file(spark, listing) and is_dir(spark, audio):
            out.append(from_protocol_file(spark, listing, find_audio_dir(spark, audio), "asvspoof2019_la", split, config.project_root))
        else:
            warnings.warn(f"the 2019 partition {split!r} is incomplete at {root}; it is left out", stacklevel=2)
    return _union(spark, out)


def deepfake_2021(spark: SparkSession, config: Config) -> DataFrame:
    """The 2021 evaluation corpus, by the first of its metadata files in order of path."""
    root = config.path("asvspoof2021_df")
    if not is_dir(spark, root):
        warnings.warn(f"no 2021 corpus at {root}", stacklevel=2)
        return empty_manifest(spark)
    listing = protocol.list_audio(spark, root, METADATA_2021).where(F.col("path").endswith("/" + METADATA_2021)).agg(F.min("path")).first()[0]
    if listing is None:
        warnings.warn(f"no {METADATA_2021} below {root}", stacklevel=2)
        return empty_manifest(spark)
    return from_protocol_file(spark, listing, find_audio_dir(spark, root), "asvspoof2021_df", "eval2021df", config.project_root)


def wavefake(spark: SparkSession, config: Config, extension: str = ".wav") -> DataFrame:
    """The corpus whose top directories are the labels; names that say nothing are spoof and warned of."""
    root = config.path("wavefake")
    if not is_dir(spark, root):
        warnings.warn(f"no generator corpus at {root}", stacklevel=2)
        return empty_manifest(spark)
    files = protocol.list_audio(spark, root, extension)
    rows = protocol.from_directories(files, root, "wavefake", "evalwavefake", config.project_root)
    names = rows.select(F.regexp_extract("utt_id", "^([^/]*)/", 1).alias("dir")).distinct()
    odd = [r.dir for r in names.where(protocol.unrecognised(F.col("dir"))).orderBy("dir").collect()]
    for name in odd:
        warnings.warn(f"directory {name!r} is neither a known generator nor a known corpus; its files are spoof", stacklevel=2)
    if not odd and names.isEmpty():
        warnings.warn(f"no *{extension} files below {root}", stacklevel=2)
    return rows


def demo(spark: SparkSession, config: Config) -> DataFrame:
    """The generated corpus, as a training split."""
    root = config.path("synthetic")
    listing, audio = os.path.join(root, "protocol.txt"), os.path.join(root, "flac")
    if not (is_file(spark, listing) and is_dir(spark, audio)):
        warnings.warn(f"no generated corpus at {root}", stacklevel=2)
        return empty_manifest(spark)
    return from_protocol_file(spark, listing, audio, "synthetic_demo", "train", config.project_root)
