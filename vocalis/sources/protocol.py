"""Protocol listings: fields of a line are found by their shape, so several column layouts parse alike."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.schemas import NO_ATTACK, UNKNOWN_SPEAKER

# Shapes of the fields and tables of directory names.
UTTERANCE = r"(?U)^(LA|PA|DF)_[TDE]_\d+$"
SPEAKER = r"(?U)^(LA|PA)_\d{4}$"
ATTACK = r"(?U)^A\d{2}$"
LABEL = r"(?i)^(bonafide|spoof)$"
CORPUS_PREFIXES = ("ljspeech_", "jsut_")
GENERATORS = ("melgan", "wavegan", "hifigan", "waveglow", "wavernn", "waveflow", "avocodo", "bigvgan", "diffwave", "vocoder", "tts", "gan")
REAL_HINTS = ("ljspeech", "jsut", "real", "bonafide")
CORPUS_SPEAKERS = ("ljspeech", "jsut")


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")


def first_like(words: Column, pattern: str) -> Column:
    return F.get(F.filter(words, lambda t: t.rlike(pattern)), 0)


def recognised(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with utt_id, speaker, attack, label and `kind`: row, skipped (no id or label), or ignored (blank or comment)."""
    w = tokens(F.col(column))
    out = lines.withColumns({"utt_id": first_like(w, UTTERANCE), "speaker": F.coalesce(first_like(w, SPEAKER), F.lit(UNKNOWN_SPEAKER)), "attack": F.coalesce(first_like(w, ATTACK), F.lit(NO_ATTACK)), "label": F.lower(first_like(w, LABEL))})
    ignored = F.col(column).isNull() | F.col(column).rlike(r"(?U)^\s*(#|$)")
    return out.withColumn("kind", F.when(ignored, "ignored").when(F.col("utt_id").isNull() | F.col("label").isNull(), "skipped").otherwise("row"))


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with utt_id, speaker, attack and label; blank lines, comments and lines without id or label go."""
    return recognised(lines, column).where("kind = 'row'").drop("kind")


def line_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: n_rows, n_skipped, n_ignored, and n_unknown_speaker among the rows."""
    kind = F.col("kind")
    return recognised(lines, column).agg(*(F.count_if(kind == k).alias(n) for n, k in (("n_rows", "row"), ("n_skipped", "skipped"), ("n_ignored", "ignored"))), F.count_if((kind == "row") & (F.col("speaker") == UNKNOWN_SPEAKER)).alias("n_unknown_speaker"))


def read_protocol(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, speaker, attack, label) of a listing. An unusable one is an error; skipped lines and unknown speakers are warned of once."""
    lines = spark.read.text(path)
    n = line_counts(lines).first()
    if not n.n_rows:
        raise ValueError(f"No usable lines in {path}")
    if n.n_skipped:
        warnings.warn(f"{path}: skipped {n.n_skipped} of {n.n_skipped + n.n_rows} lines", stacklevel=2)
    if n.n_unknown_speaker:
        warnings.warn(f"{path}: {n.n_unknown_speaker} rows without a speaker are {UNKNOWN_SPEAKER!r}; a split by speaker cannot keep them apart", stacklevel=2)
    return parsed(lines).select("utt_id", "speaker", "attack", "label")


def names_any(name: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda part: F.contains(name, part))


def directory_label(directory: Column) -> Column:
    """bonafide for names of real corpora, spoof for names of generators (which win) and all others."""
    name = F.lower(F.trim(directory))
    return F.when(~names_any(name, GENERATORS) & names_any(name, REAL_HINTS), "bonafide").otherwise("spoof")


def unrecognised(directory: Column) -> Column:
    """Whether a name is neither a generator's nor a real corpus's."""
    name = F.lower(F.trim(directory))
    return ~names_any(name, GENERATORS) & ~names_any(name, REAL_HINTS)


def generator_name(directory: Column) -> Column:
    """The directory's name without a leading corpus name."""
    return F.regexp_replace(F.lower(F.trim(directory)), f"^({'|'.join(CORPUS_PREFIXES)})", "")


def list_audio(spark: SparkSession, root: str, extension: str = ".flac") -> DataFrame:
    """(path, length) of the files below root; contents are not read. Local paths come without a scheme."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def stems(files: DataFrame) -> DataFrame:
    """(utt_id, path): each file under its name without directory and extension."""
    return files.select(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "").alias("utt_id"), "path")


def from_protocol(protocol: DataFrame, audio_dir: str, source_corpus: str, split: str, files: DataFrame | None = None, project_root: str = "", extension: str = ".flac") -> DataFrame:
    """Manifest rows of the protocol's utterances at <audio_dir>/<utt_id><extension>; with files (path), of those listed there alone."""
    from vocalis.operators.manifest import finalize, relative_path

    rows = protocol.withColumn("path", F.concat(F.lit(audio_dir.rstrip("/") + "/"), "utt_id", F.lit(extension)))
    if files is not None:
        rows = rows.join(files.select("path"), "path", "left_semi")
    return finalize(rows.withColumn("path", relative_path(F.col("path"), project_root) if project_root else F.col("path")), source_corpus, split)


def from_directories(files: DataFrame, root: str, source_corpus: str, split: str, project_root: str = "") -> DataFrame:
    """Manifest rows of a corpus whose directories, right below root, are the labels."""
    from vocalis.operators.manifest import finalize, relative_path

    below = F.split(relative_path(F.col("path"), root), "/")
    rows = files.where(F.size(below) > 1).withColumns({"_dir": F.get(below, 0), "_stem": F.regexp_replace(F.element_at(below, -1), r"\.[^.]*$", "")})
    name = F.lower("_dir")
    speaker = F.coalesce(F.get(F.filter(F.array(*map(F.lit, CORPUS_SPEAKERS)), lambda c: F.contains(name, c)), 0), name)
    rows = rows.withColumns({"label": directory_label(F.col("_dir")), "utt_id": F.concat_ws("/", "_dir", "_stem"), "speaker": speaker})
    rows = rows.withColumn("attack", F.when(F.col("label") == "spoof", generator_name(F.col("_dir"))).otherwise(F.lit(NO_ATTACK)))
    return finalize(rows.withColumn("path", relative_path(F.col("path"), project_root) if project_root else F.col("path")), source_corpus, split)
